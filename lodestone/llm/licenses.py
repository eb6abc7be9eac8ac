"""License scans with DataFrame functions alone: phrases, and an exact set-similarity join of text blocks with templates.

A block is a run of 1 to LINES neighbouring lines, so notices meet their template however they are wrapped
over so many lines. Templates are token sets; a block meets one where it holds at least the threshold's
share of its tokens. Tokens are ordered by how often they stand in all documents, rarest first: a block
that meets a template must hold one of the template's first |T| - need + 1 tokens (prefix filter), have
need tokens of its own at least (length filter), and from the place of its first common token on as many
as are still needed must be left in both (positional filter). What passes is counted exactly. Templates are
few (constants, or a small table given), so their side of the join is part of the plan.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows each get a
row; an empty table gives an empty result; other columns are ignored; of a very long text only the template
tokens of each line are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Opening words of common notices, in lower case.
TEMPLATES = {
    "gpl-notice": "this work is licensed under the gnu general public license version",
    "gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-release": "this work is released under the mit license",
    "cc-by-4": "this work is licensed under cc by 4 0",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike license",
    "cc0": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license version 2 0",
    "reserved": "all rights reserved",
}
THRESHOLD, LINES = 0.8, 3
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """' w1 w2 ... ' of the words of a text; one space for none.

    Letters beyond A-Z get lower as well, which is much faster than to leave them out and changes no place where
    words part, nor a word of a phrase or template: the one of them whose lower case is a letter of a-z, the sign
    for kelvin, is another sign before.
    """
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u2126"))), F.lit(" ")), _NOT_WORD, " ")


def spaces(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def templates(frequency: dict[str, int], threshold: float = THRESHOLD, said: dict[str, str] = TEMPLATES) -> list[tuple[str, list[str], int]]:
    """(label, tokens from rare to frequent, how many of them are needed)."""
    out = []
    for label, text in sorted(said.items()):
        tokens = sorted(set(text.split()), key=lambda t: (frequency.get(t, 0), t))
        if tokens:
            out.append((label, tokens, math.ceil(threshold * len(tokens) - 1e-9)))
    return out


def read_templates(table: DataFrame, label_col: str = "label", text_col: str = "text") -> dict[str, str]:
    """Templates of a table of a few rows, which become part of the plan; a label's texts are told apart by a number."""
    rows = table.select(F.col(label_col).cast("string").alias("label"), F.trim(normal(F.col(text_col).cast("string"))).alias("text")).where("label is not null and text <> ''").distinct().orderBy("label", "text").collect()
    seen: dict[str, int] = {}
    out = {}
    for r in rows:
        n = seen[r.label] = seen.get(r.label, 0) + 1
        out[r.label if n == 1 else f"{r.label}-{n}"] = r.text
    return out


def scan(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id", lines: int = LINES, said: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) of each row.

    blocks: of each block that meets a template, its first line's number, how many lines it has, the template's
    label and the share. lines: the most neighbouring lines that a block joins. said: the templates by label.
    """
    said = TEMPLATES if said is None else said
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vocabulary = sorted({t for x in said.values() for t in x.split()})

    # How often each template token stands in all documents.
    padded = src.select(normal(F.col("text")).alias("n"))
    tokens = padded.select(F.explode(F.split("n", " ")).alias("t")).where(F.col("t").isin(vocabulary)).groupBy("t").count()
    frequency = {r["t"]: r["count"] for r in tokens.collect()}  # at most one row for each template token
    made = templates(frequency, threshold, said)
    order = sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}

    # Under each token's rank, the templates whose prefix has it: what a block's token is looked up in.
    entry = lambda label, held, need, place: F.struct(F.lit(label).alias("label"), F.lit(place).alias("place"), F.lit(len(held)).alias("size"), F.lit(need).alias("need"), F.array(*[F.lit(rank[t]) for t in held]).alias("tokens"))
    under: dict[str, list[Column]] = {}
    for label, held, need in made:
        for place, t in enumerate(held[: len(held) - need + 1]):
            under.setdefault(t, []).append(entry(label, held, need, place))
    kind = "array<struct<label:string,place:int,size:int,need:int,tokens:array<int>>>"
    by_rank = F.array(*[F.array(*under[t]) if t in under else F.array().cast(kind) for t in order]) if order else F.array().cast(f"array<{kind}>")
    some = F.lit(False)  # a row none of whose words is in a prefix has no candidate
    for t in sorted(under):
        some = some | F.contains("n", F.lit(f" {t} "))

    phrase = "|".join(PHRASES)
    base = src.withColumn("n", normal(F.col("text")))
    one = {p: F.when(F.contains("n", F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()}
    any_ = F.coalesce(*one.values()).isNotNull()
    base = base.withColumn("n_base", F.when(any_, F.regexp_count("n", F.lit(f" (?=(?:{phrase}) )"))).otherwise(0).cast("long")).select(
        "doc_id", "text", some.alias("some"), F.greatest(spaces(F.col("n")) - 1, F.lit(0)).alias("n_words"), "n_base",
        F.when(F.col("n_base") > 0, spaces(F.regexp_extract("n", f"(?s)^(.*?) (?=(?:{phrase}) )", 1))).alias("first_word"),
        F.when(F.col("n_base") > 0, spaces(F.regexp_extract("n", f"(?s)^(.*) (?=(?:{phrase}) )", 1))).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*one.values()))).alias("base"),
    )

    # Lines as ranks of the template tokens they hold; then blocks of them, the length filter before the join.
    words, least = F.array(*map(F.lit, vocabulary)).cast("array<string>"), min((need for _, _, need in made), default=1)
    number = F.create_map(*[F.lit(x) for t in vocabulary for x in (t, rank[t])]) if vocabulary else F.create_map().cast("map<string,int>")
    line = F.transform(F.split("text", "\n"), lambda x: F.transform(F.array_intersect(F.split(normal(x), " "), words), lambda t: number[t]))
    base = base.withColumn("lines", F.when(F.col("some"), line).otherwise(F.array().cast("array<array<int>>"))).drop("text")
    block = lambda k: F.transform("lines", lambda x, i: F.struct(i.alias("line"), F.lit(k).alias("lines"), F.array_sort(F.array_distinct(F.flatten(F.slice("lines", i + 1, F.lit(k))))).alias("held")))
    base = base.withColumn("runs", F.filter(F.concat(*[block(k) for k in range(1, max(lines, 1) + 1)]), lambda x: F.size(x["held"]) >= least)).drop("lines")

    # The join, row by row: each block's tokens against the templates' prefixes, then the exact count.
    def meets(x):
        n = F.size(x["held"])
        near = lambda t, i: F.filter(F.get(by_rank, t), lambda c: (n >= c["need"]) & (F.least(n - i, c["size"] - c["place"]) >= c["need"]))
        counted = F.transform(F.array_distinct(F.flatten(F.transform(x["held"], near))), lambda c: F.struct(c["label"].alias("label"), F.size(F.array_intersect(x["held"], c["tokens"])).alias("common"), c["size"].alias("size"), c["need"].alias("need")))
        met = F.filter(counted, lambda r: r["common"] >= r["need"])
        return F.array_distinct(F.transform(met, lambda r: F.struct(x["line"].alias("line"), x["lines"].alias("lines"), r["label"].alias("label"), (r["common"] / r["size"]).alias("share"))))

    found = base.withColumn("blocks", F.flatten(F.transform("runs", meets)))
    added = F.transform("blocks", lambda r: r["label"])
    best = F.coalesce(F.array_max(F.transform("blocks", lambda r: r["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_distinct("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", added))), ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"), "blocks",
    )
