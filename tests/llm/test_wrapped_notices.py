"""License notices that are wrapped over lines, templates of a table, and letters that aren't of ASCII."""

import re

from lodestone.llm import licenses

BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not"


ISC = "Permission to use, copy, modify, and/or distribute\nthis software for any purpose with or without\nfee is hereby granted."


def test_wrapped_notices(spark):
    docs = spark.createDataFrame([(1, BSD), (2, MPL), (3, "nothing\nhere"), (4, None), (5, f"x\n\n{ISC}\n" * 2)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score >= 0.8) for r in licenses.scan(docs).collect()}
    assert got == {1: ("bsd", True), 2: ("mpl-2", True), 3: ("", False), 4: ("", False), 5: ("isc", True)}
    assert {r.labels for r in licenses.scan(docs, lines=1).collect()} == {""}


def test_templates_of_a_table(spark):
    docs = spark.createDataFrame([(1, "Free\nas in beer, for everyone"), (2, "free beer"), (3, "")], "doc_id long, text string")
    table = spark.createDataFrame([("beer", "Free as in beer!"), ("beer", "for everyone"), (None, "x"), ("none", None), ("empty", "..")], "label string, text string")
    said = licenses.read_templates(table)
    assert said == {"beer": "for everyone", "beer-2": "free as in beer"}
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs, said=said).collect()}
    assert got == {1: ("beer,beer-2", 1.0), 2: ("", 0.0), 3: ("", 0.0)}
    assert licenses.scan(docs, said={}).where("labels <> ''").count() == 0


def test_only_letters_of_ascii_match(spark):
    """Signs whose lower case is or begins like a letter of a-z are no such letters."""
    odd = ["this wor\u212a is released under the mit license", "M\u0130T LICENSE", "mit l\u0130cense", "\u2126 GNU General Public License \u03a3", "\u00c9 CC BY \u00c9\u0130\u212a x", "\u1e9e", ""]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    low, word = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    for r in licenses.scan(docs).collect():
        w = re.findall(word, odd[r.doc_id].translate(low))
        at = [i for p in licenses.PHRASES for q in [p.split()] for i in range(len(w)) if w[i : i + len(q)] == q]
        assert (r.n_words, r.n_base, r.first_word) == (len(w), len(at), min(at, default=None)), odd[r.doc_id]
