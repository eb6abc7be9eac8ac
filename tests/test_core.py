"""The semantics that the SQL comparison doesn't reach, on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone import extensions
from lodestone.functions import geo, scalar as A, text as X, times
from lodestone.operators import facets, index, joins, tables, windows
from lodestone.operators.expression import Compiler
from lodestone.operators.select import escalate, page, select
from lodestone.plans import syntax as S
from lodestone.sources import io, logical
from lodestone.sources.database import Database
from lodestone.streaming import windows as streams


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(1, "a b c d e f g i"), (2, "a x"), (3, "c b a"), (4, None), (5, "")], "id long, t string")


def found(df, script):
    return sorted(r.id for r in select(df, filter=script).records.collect())


def test_near_intervals(words):
    assert found(words, 't *N5 "a g"') == [1]
    assert found(words, 't *N5 "a i"') == []
    assert found(words, 't *N10 "a c"') == [1, 3]
    assert found(words, 't *ONP10 "a c"') == [1]
    assert found(words, 't *NP10,0,,2 "a c"') == []
    assert found(words, 't *NPP10 "(a x) (c)"') == [1, 3]


def test_truthy_or_and_null(words):
    assert found(words, 't || id == 5') == [1, 2, 3, 5]
    assert found(words, 't == null') == [4]
    assert found(words, '!(t @ "a")') == [4, 5]
    df = select(words, output_columns='id, t || "unknown"').records
    assert sorted(map(tuple, df.collect()))[3:] == [(4, "unknown"), (5, "unknown")]


def test_scores_add_and_adjust(spark):
    df = spark.createDataFrame([("k", "x y x")], "k string, t string")
    score = lambda s: df.select(Compiler(df).score(S.parse_script(s))).first()[0]
    assert score('t @ "x" && t @ "y"') == 3
    assert score('t @ "x" &! t @ "y"') == 2
    assert score('t @ "y" *> t @ "x" * 1.5') == 4
    assert score('t @ "y" *< t @ "x" * 2.5') == -4
    assert score('scorer_tf_at_most(t, "x", 1)') == 1


def test_steps_belong_in_scorers(spark):
    df = spark.createDataFrame([(1, 5), (2, 7)], "k long, n long")
    for bad in ("n++", "n++ > 2", "--n"):
        with pytest.raises(S.SyntaxProblem):
            select(df, filter=bad)
    got = select(df, scorer="_score++, n--, _score *= 3", output_columns="k, n, _score", key="k").records
    assert sorted(map(tuple, got.collect())) == [(1, 4, 6.0), (2, 6, 6.0)]


def test_parse_errors():
    for bad in ("a ==", "(a", "1++", "--2", "'x"):
        with pytest.raises(S.SyntaxProblem):
            S.parse_script(bad)
    with pytest.raises(S.SyntaxProblem):
        S.parse_query("-a", "t")


def test_query_language(words):
    ids = lambda q, **k: sorted(r.id for r in select(words, query=q, match_columns="t", **k).records.collect())
    assert ids("a -x") == [1, 3]
    assert ids("x OR d") == [1, 2]
    assert ids('"b a"') == [3]
    assert ids("id:>=4") == [4, 5]
    assert ids("*") == [1, 2, 3, 4, 5]
    assert ids('t:^c') == [3]
    assert ids('t:$x') == [2]


def test_negative_offset(spark):
    df = spark.range(1, 11)
    assert col(page(df.orderBy("id"), -12, 5), "id") == [1, 2, 3]
    assert col(page(df.orderBy("id"), -12, 1), "id") == []
    assert col(page(df.orderBy("id"), -3, 2), "id") == [8, 9]


def test_power_set_and_vectors(spark):
    df = spark.createDataFrame([(["A", "B"],), (["A"],), ([],), (None,)], "tags array<string>")
    got = {tuple(r.tags): r._nsubrecs for r in facets.drilldown(df, "tags", key_vector_expansion="POWER_SET").collect()}
    assert got == {("A",): 2, ("B",): 1, ("A", "B"): 1}
    v = spark.createDataFrame([([10, 20, 30],), ([40, 90],)], "v array<long>").withColumn("k", F.lit(1))
    r = facets.drilldown(v, "k", "SUM,MEAN", "v").first()
    assert (r._sum, r._mean) == (190, 38)


def test_sd(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "k int, v double")
    got = {r.k: r.s for r in facets.drilldown(df, "k", aggregates={"s": facets.aggregator_sd("v", True)}).collect()}
    assert math.isnan(got[2]) and abs(got[1] - math.sqrt(2)) < 1e-12


def test_windows_run_by_rows(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, k int")
    assert sorted(col(df, windows.window_sum("id", None, "k", ["id"]))) == [1, 3, 6]
    assert sorted(col(df, windows.rank(None, "k"))) == [1, 1, 3]
    assert col(df, windows.window_count("k").alias("n")) != []


def test_strings(spark):
    df = spark.createDataFrame([("Hello World",)], "s string")
    one = lambda c: df.select(c).first()[0]
    assert one(A.string_substring(F.col("s"), -5)) == "World"
    assert one(A.string_substring(F.col("s"), 50, 2, "?")) == "?"
    assert one(A.string_truncate(F.col("s"), 8)) == "Hello..."
    assert one(A.string_slice_regexp(F.col("s"), r"(?<first>\w+) (?<second>\w+)", "second")) == "World"
    assert one(A.highlight_html(F.col("s"), ["world"])) == 'Hello <span class="keyword">World</span>'
    assert one(A.snippets(F.col("s"), ["world"], 9)) == ["o [[World]]"]
    assert one(A.fuzzy_distance(F.col("s"), "Hlelo World")) == 1


def test_vectors_and_distances(spark):
    df = spark.createDataFrame([([1, 2, 3], [0.0, 0.0])], "v array<int>, z array<double>")
    one = lambda c: df.select(c).first()[0]
    assert one(A.vector_slice(F.col("v"), -2)) == [2, 3]
    assert one(A.vector_slice(F.col("v"), 5)) == []
    assert one(A.vector_find(F.col("v"), 2, "GREATER")) == 3
    assert one(A.vector_find(F.col("v"), 9)) is None
    assert one(A.distance_cosine(F.col("z"), F.col("z"))) == 1.0


def test_times(spark):
    df = spark.sql("select timestamp'2024-01-07 13:47:59' as t")
    one = lambda c: str(df.select(c).first()[0])
    assert one(times.classify_week(F.col("t"))) == "2024-01-07 00:00:00"
    assert one(times.classify_minute(F.col("t"), 20)) == "2024-01-07 13:40:00"
    assert one(times.classify_month(F.col("t"), 5)) == "2024-01-01 00:00:00"
    assert one(times.format(F.col("t"), "%H:%M at %d")) == "13:47 at 07"


def test_geo(spark):
    df = spark.range(1).select(geo.at("35.0,139.0").alias("a"), geo.at("35.0,140.0").alias("b"))
    d = [df.select(geo.distance(F.col("a"), F.col("b"), k)).first()[0] for k in ("rectangle", "sphere", "ellipsoid")]
    assert all(90000 < x < 92000 for x in d)
    across = geo.in_rectangle(geo.at("0.0,179.9"), geo.at("1.0,179.0"), geo.at("-1.0,-179.0"))
    assert spark.range(1).select(across).first()[0]


def test_lookups(spark, monkeypatch):
    shops = spark.createDataFrame([(1, ["a", "c"]), (2, [])], "id int, tags array<string>")
    tags = spark.createDataFrame([("a", 10), ("b", 20)], "k string, n int")
    got = {r.id: r.ns for r in joins.reference_vector(shops, tags, "tags", "k", "n", "ns", "id").collect()}
    assert got == {1: [10, None], 2: None}
    monkeypatch.setattr(tables, "BLOCK", 2)  # more conditions than one block holds
    got = joins.in_records(spark.range(9), spark.range(5).withColumnRenamed("id", "c"), (F.col("id"), "LESS", "c"))
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3]
    assert joins.in_records(spark.range(9), spark.range(0).withColumnRenamed("id", "c"), (F.col("id"), "LESS", "c")).count() == 0


def test_upsert_if_exists(spark):
    old = spark.createDataFrame([("a", 1), ("b", 5)], "k string, n int")
    new = spark.createDataFrame([("a", 7, 1), ("a", 8, 2), ("b", 9, 1), ("c", 3, 1)], "k string, n int, at int")
    got = sorted(map(tuple, io.upsert(old, new, "k", "at", "n < 3").collect()))
    assert got == [("a", 8), ("b", 5), ("c", 3)]


def test_dump_restore_and_formats(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    said = io.dump({"T": df}, str(tmp_path / "d"))
    assert said == "CREATE TABLE T (k string, n int) USING parquet"
    assert sorted(map(tuple, io.restore(spark, str(tmp_path / "d"), "T", df.schema).collect()), key=str) == [("a", 1), ("b", None)]
    io.to_tsv(df, str(tmp_path / "t"))
    assert io.load_tsv(spark, str(tmp_path / "t")).count() == 2
    assert io.load_arrow(spark, io.to_arrow(df)).count() == 2
    assert sorted(map(tuple, io.fill_defaults(df).collect())) == [("a", 1), ("b", 0)]
    assert io.load_rows(spark, [["k", "n"], ["x", 1]]).columns == ["k", "n"]
    assert io.create_similar(df).count() == 0


def test_logical_partitions_are_pruned(spark, tmp_path):
    df = spark.sql("select id, timestamp'2024-01-01' + make_interval(0, 0, 0, id) as ts from range(10)")
    logical.write(df, str(tmp_path / "l"), "ts")
    t = logical.read(spark, str(tmp_path / "l"))
    got = logical.range_filter(t, "ts", "2024-01-03", "2024-01-05", limit=-1, key="id")
    assert col(got, "id") == [2, 3, 4]
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString() or "shard" in got._jdf.queryExecution().toString()
    assert logical.shard_list(t).count() == 10


def test_postings_search(spark, tmp_path):
    df = spark.createDataFrame([(1, "x y x"), (2, "y"), (3, None)], "id long, t string")
    p = index.postings(df, "id", "t")
    assert {(r.token, r.key): r.positions for r in p.collect()} == {("x", 1): [0, 2], ("y", 1): [1], ("y", 2): [0]}
    index.write(p, str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert [tuple(r) for r in index.search(stored, ["x", "y"]).collect()] == [(1, 3)]
    assert sorted(tuple(r) for r in index.search(stored, ["x", "y"], every=False).collect()) == [(1, 3), (2, 1)]


def test_escalate(spark):
    df = spark.range(10)
    assert escalate(df, ["id == 1", "id < 4", "id < 9"], [0, 0]).count() == 1
    assert escalate(df, ["id == 1", "id < 4", "id < 9"], [1, 3]).count() == 4
    assert escalate(df, ["id == 1", "id < 4", "id < 9"], [1, 4]).count() == 9


def test_tokenizers(spark):
    df = spark.createDataFrame([("Hello 世界 12!",)], "t string")
    tokens = lambda name, **k: df.select(X.tokenize(F.col("t"), name, **k)).first()[0]
    assert tokens("TokenBigram")[:3] == ["hello", "世界", "界"]
    assert tokens("TokenDelimit") == ["hello", "世界", "12!"]
    assert tokens("TokenPattern", pattern=r"\d+") == ["12"]
    assert tokens("TokenNgram", n=3)[0] == "hel"


def test_streams(spark, tmp_path):
    df = spark.sql("select id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) as ts, cast(id % 2 as string) as who from range(6)")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    s = streams.tumbling(streams.read(spark, str(tmp_path / "in"), df), "ts", "2 hours", late="1 hour")
    q = s.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("tumbled").collect()) == [2, 2, 2]
    q = streams.learn(streams.read(spark, str(tmp_path / "in"), df), "who", "id", "id", str(tmp_path / "learnt"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert streams.learned(spark, str(tmp_path / "learnt")).agg(F.sum("n")).first()[0] == 4
    assert streams.sessions(df, "ts", "30 minutes", ["who"]).count() == 6


def test_normalizer_options(spark):
    one = lambda said, name="NormalizerNFKC", **o: spark.range(1).select(X.normalize(F.lit(said), name, **o).alias("x")).first().x
    assert one("ＡＢＣ ﬁ ㍿", unify_kana=True) == "abc fi 株式会社"
    assert one("あイ", unify_kana=True) == "あい" and one("ァっ", unify_kana_case=True) == "アつ"
    assert one("ガば", unify_kana_voiced_sound_mark=True) == "カは" and one("ヴァイオリン", unify_katakana_v_sounds=True) == "バイオリン"
    assert one("ローマ", unify_to_romaji=True) == "ro-ma" and one("にっぽん", unify_to_romaji=True) == "nippon"
    assert one("カー", unify_kana_prolonged_sound_mark=True) == "カア" and one("か-", unify_kana_hyphen=True) == "かあ"
    assert one("Ä é", unify_latin_alphabet_with=True) == "a e" and one("a－b–c", unify_hyphen=True) == "a-b-c"
    assert one(" a b\n!", remove_blank=True, remove_symbol=True) == "ab" and one("  a ", strip=True) == "a"
    assert one("時々", unify_iteration_mark=True) == "時時" and one("ニホン", unify_to_katakana=True) == "ニホン" and one("nihon", unify_to_katakana=True) == "ニホン"
    assert one("<b>A</b>&amp;", "NormalizerHTML") == "a&"


def test_readings_by_prefix(spark):
    df = spark.createDataFrame([("ニホン",), ("ニッポン",), ("ローマジ",), ("シャ",), ("ギャ",)], "_key string")
    ask = lambda q: sorted(r[0] for r in select(df, filter=f'prefix_rk_search(_key, "{q}")').records.collect())
    assert ask("ni") == ["ニッポン", "ニホン"] and ask("n") == ["ニッポン", "ニホン"] and ask("nip") == ["ニッポン"] and ask("nippo") == ["ニッポン"]
    assert ask("に") == ["ニッポン", "ニホン"] and ask("sh") == ["シャ"] and ask("sya") == ["シャ"] and ask("gy") == ["ギャ"] and ask("zz") == []


def test_highlight_and_snippet_goldens(spark):
    df = spark.createDataFrame([(1, "<b>Polestar</b> is a Ruby binding of Lodestar."), (2, "Morning is a ＱｕｅＲＹ engine"), (3, None)], "k long, body string")
    one = lambda k, said, **p: select(df.where(f"k = {k}"), output_columns=said, **p).records.first()[0]
    assert one(1, 'highlight(body, "lodestar", "<span class=\\"k1\\">", "</span>")') == '<b>Polestar</b> is a Ruby binding of <span class="k1">Lodestar</span>.'
    assert one(1, 'highlight(body, "lodestar", "<i>", "</i>", {"html_mode": true})') == "&lt;b&gt;Polestar&lt;/b&gt; is a Ruby binding of <i>Lodestar</i>."
    assert one(1, 'highlight(body, "lodestar", "polestar", {"sequential_class_tag_mode": true})') == '<b><mark class="keyword-1">Polestar</mark></b> is a Ruby binding of <mark class="keyword-0">Lodestar</mark>.'
    assert one(2, 'highlight(body, "query", "[", "]")') == "Morning is a [ＱｕｅＲＹ] engine"
    assert one(2, 'highlight_full(body, "", false, "query", "[", "]", "is", "(", ")")') == "Morning (is) a ＱｕｅＲＹ engine"
    assert one(1, "highlight_html(body)", query="ruby", match_columns="body") == '&lt;b&gt;Polestar&lt;/b&gt; is a <span class="keyword">Ruby</span> binding of Lodestar.'
    assert one(1, "snippet_html(body)", query="ruby", match_columns="body") == ['&lt;b&gt;Polestar&lt;/b&gt; is a <span class="keyword">Ruby</span> binding of Lodestar.']
    assert one(1, 'snippet(body, "none", "[", "]", {"default": "-"})') == ["-"] and one(1, 'snippet(body, "none", "[", "]")') is None and one(3, 'highlight(body, "a", "b", "c")') is None
    with pytest.raises(S.SyntaxProblem):
        one(1, 'highlight(body, "a", "b")')


def test_fuzzy_scores_and_escalation_goldens(spark):
    names = spark.createDataFrame([("Tom",), ("Tomy",), ("Ken",)], "_key string")
    got = select(names, filter='fuzzy_search(_key, "To", 1)', output_columns="_key, _score").records
    assert [tuple(r) for r in got.collect()] == [("Tom", 1.0)]
    numbers = spark.createDataFrame([(i, 10 * i, 100 * i) for i in range(1, 11)], "data1 int, data2 int, data3 int")
    got = select(numbers, filter="data1 <= 9 && escalate('data1 <= 1', 2, 'data2 > 50', 4, 'data3 > 0')").records
    assert sorted(col(got, "data1")) == [1, 6, 7, 8, 9]


def test_accessors_of_vectors_and_nothing(spark):
    users = spark.createDataFrame([("a", 1), ("b", 2)], "_key string, age int")
    groups = spark.createDataFrame([("g1", ["a"]), ("g2", ["b", "a"]), ("g3", []), ("g4", None), ("g5", ["zz"])], "_key string, users array<string>")
    t = tables.Table(groups, "_key", {"users": "Users"})
    ask = lambda **p: select(t, tables={"Users": tables.Table(users, "_key")}, **p).records
    assert {r[0]: r[1] for r in ask(output_columns="_key, users.age").collect()} == {"g1": [1], "g2": [2, 1], "g3": None, "g4": None, "g5": None}
    assert col(ask(filter='sub_filter(users, "age > 1")'), "_key") == ["g2"]
    assert sorted(col(ask(filter='!sub_filter(users, "age > 1")'), "_key")) == ["g1", "g3", "g4", "g5"]
    assert ask().columns == ["_key", "users"]
    with pytest.raises(S.SyntaxProblem):
        select(groups, references={"users": "Users"}, tables={"Users": users}, filter="users.age > 1")


def test_record_numbers_are_dense(spark, monkeypatch):
    monkeypatch.setattr(tables, "PIECES", 3)
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(100)], "k string").repartition(5)
    assert [r._id for r in tables.with_id(df, "k").orderBy("k").collect()] == list(range(1, 101))
    assert tables.with_id(df.limit(0), "k").count() == 0


def test_stems(spark):
    words = ["cats", "ponies", "caresses", "walking", "walked", "hopping", "hoped", "sky", "happy", "relational", "is", "bring", "été"]
    got = spark.createDataFrame([(words,)], "w array<string>").select(X.token_filter(F.col("w"), "TokenFilterStem").alias("s")).first().s
    assert got == ["cat", "poni", "caress", "walk", "walk", "hop", "hop", "sky", "happi", "relate", "is", "bring", "été"]
    said = spark.createDataFrame([(["develops", "developing", "developed", "develop"],)], "w array<string>")
    assert said.select(X.token_filter(F.col("w"), "TokenFilterStem").alias("s")).first().s == ["develop"] * 4
    assert said.select(X.token_filter(F.col("w"), "TokenFilterStem", keep_original=True).alias("s")).first().s == ["develop", "develops", "develop", "developing", "develop", "developed", "develop"]
    with pytest.raises(ValueError):
        X.token_filter(F.col("w"), "TokenFilterStem", algorithm="french")
    nfkc = spark.createDataFrame([(["ＡＢ", "ｃ"],), ([],)], "w array<string>").select(X.token_filter(F.col("w"), "TokenFilterNFKC").alias("s")).collect()
    assert [r.s for r in nfkc] == [["ab", "c"], []]


@pytest.mark.parametrize("x, want", [(None, "c0"), (True, "c3"), (5, "05"), (-3, "fd"), (200, "ccc8"), (70000, "ce00011170"), (-200, "d1ff38"), (1.5, "cb3ff8000000000000"), ("é", "a2c3a9"), (b"\x01", "c40101"), ([1, "a"], "9201a161"), ({"k": None}, "81a16bc0"), ("x" * 40, "d928" + "78" * 40)])
def test_message_pack(x, want):
    assert io.pack_message(x).hex() == want


def test_database_refuses(spark):
    db = Database(spark, {"A": tables.Table(spark.createDataFrame([(1, 2)], "k int, b int"), "k", {"b": "B"}), "B": tables.Table(spark.createDataFrame([(2,)], "k int"), "k")})
    for bad in (lambda: db.table_remove("B"), lambda: db.table_rename("A", "B"), lambda: db.column_remove("A", "k"), lambda: db.table_create("A", "k int"), lambda: db["none"], lambda: db.command("none"), lambda: db.command("_put")):
        with pytest.raises(S.SyntaxProblem):
            bad()
    db.table_rename("B", "C")
    assert db["A"].references == {"b": "C"}
    db.table_remove("C", dependent=True)
    assert db["A"].df.columns == ["k"]
    db.truncate("A")
    assert db["A"].df.count() == 0
    db.load("A", [{"k": None}, {"k": 5}])
    assert col(db["A"].df, "k") == [5]


def test_negative_offsets_without_a_count(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "k long, m long")
    order = sorted(((m, -k) for k, m in ((i, i % 3) for i in range(10))))
    want = [-k for _, k in order]
    for offset, limit in ((-3, 2), (-3, None), (-10, 4), (-12, 5), (-30, 5), (-1, 1), (-4, 0)):
        got = col(select(df, sort_keys="m, -k", key="k", offset=offset, limit=limit).records, "k")
        start = 10 + offset
        n = len(want) if limit is None else limit
        assert got == (want[start : start + n] if start >= 0 else want[: max(n + start, 0)]), (offset, limit)


def test_http_front_end(spark):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    from lodestone import server

    db = Database(spark, {"T": tables.Table(spark.createDataFrame([(i, f"name{i}", i % 2) for i in range(30)], "k long, name string, odd long"), "k")})
    s = server.serve(db, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    ask = lambda path, data=None, **p: urlopen(Request(f"http://127.0.0.1:{s.server_address[1]}{path}?{urlencode(p)}", data)).read()
    try:
        head, body = json.loads(ask("/d/select", table="T", filter="k >= 4", sort_keys="-k", limit="3", output_columns="k, name", **{"drilldowns[o].keys": "odd", "drilldowns[o].sort_keys": "odd", "columns[twice].stage": "filtered", "columns[twice].value": "k * 2"}))
        assert head[0] == 0 and body["records"] == [[["k", "bigint"], ["name", "string"]], [29, "name29"], [28, "name28"], [27, "name27"]]
        assert body["drilldowns"]["o"][1:] == [[0, 13], [1, 13]]
        assert len(json.loads(ask("/d/select", table="T"))[1]["records"]) == 1 + server.LIMIT
        assert json.loads(ask("/d/load", b'[{"k": 99, "name": "new"}]', table="T", output_ids="yes"))[1] == {"loaded": 1, "ids": [[["k", "bigint"]], [99]]}
        assert ask("/d/select.tsv", table="T", filter="k == 99", output_columns="k, name").decode() == "k\tname\n99\tnew\n"
        assert b"<ELEMENT>new</ELEMENT>" in ask("/d/select.xml", table="T", filter="k == 99") and ask("/d/object_exist.msgpack", name="T.k")[-1:] == b"\xc3"
        for bad in ("/d/select?table=none", "/d/none", "/x", "/d/select?table=T&filter=k+%3D%3D"):
            with pytest.raises(HTTPError) as e:
                urlopen(f"http://127.0.0.1:{s.server_address[1]}{bad}")
            assert e.value.code == 400
    finally:
        s.shutdown()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spark.createDataFrame([(i, f"n{i}", float(i), None if i % 2 else "x") for i in range(50)], "k long, name string, price double, maybe string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = select(df, filter='price >= 10 && name == "n12" && maybe != "y"', output_columns="k").records
    said = plan(got)
    assert all(x in said for x in ("GreaterThanOrEqual(price,10.0)", "EqualTo(name,n12)", "IsNull(maybe)")) and "ReadSchema: struct<k:bigint,name:string,price:double,maybe:string>" in said
    assert col(got, "k") == [12] and "ReadSchema: struct<name:string>" in plan(facets.drilldown(df, "name"))


def test_only_the_shards_of_a_range_are_read(spark, tmp_path):
    rows = spark.sql("SELECT id AS k, timestamp_seconds(1704067200 + id * 3600 * 6) AS ts FROM range(80)")
    logical.write(rows, str(tmp_path / "log"), "ts")
    df = logical.read(spark, str(tmp_path / "log"))
    inside = logical.within(df, "ts", "2024-01-05", "2024-01-06T12:00:00")
    said = plan(inside)
    assert "PartitionFilters: [" in said and "20240105" in said.split("PartitionFilters: [")[1].split("PushedFilters")[0] and inside.count() == 7
    assert sorted(r.k for r in logical.remove(df, "ts", "2024-01-02", "2024-01-19").collect()) == [0, 1, 2, 3, *range(73, 80)]  # k = 72 is the 19th's first
    logical.remove_in_place(spark, str(tmp_path / "log"), "ts", "2024-01-02T06:00:00", "2024-01-19")
    left = logical.read(spark, str(tmp_path / "log"))
    assert sorted(col(left, "k")) == [0, 1, 2, 3, 4, *range(73, 80)] and col(logical.shard_list(left), "shard") == ["20240101", "20240102", "20240119", "20240120"]


def test_a_written_index_is_read_by_buckets(spark, tmp_path):
    df = spark.createDataFrame([(i, f"w{i % 40} common w{(i * 7) % 40}") for i in range(200)], "k long, t string")
    index.write(index.postings(df, "k", "t"), str(tmp_path / "i"), buckets=32)
    p = spark.read.parquet(str(tmp_path / "i"))
    got = index.search(p, ["w3", "common"], buckets=32)
    assert "PartitionFilters: [isnotnull(bucket" in plan(got) or "PartitionFilters: [bucket" in plan(got)
    assert {r.key: r._score for r in got.collect()} == {i: 1 + (i % 40 == 3) + (i * 7 % 40 == 3) for i in range(200) if 3 in (i % 40, i * 7 % 40)}
    few = index.frequencies(df, "k", "t", only=["W3", "common"])
    assert sorted(map(tuple, few.collect())) == sorted((r.token, r.key, r.tf) for r in index.frequencies(df, "k", "t").where("token in ('w3', 'common')").collect())
    assert index.frequencies(df, "k", "t", only=[]).count() == 0


def test_json_html_and_tables_of_replacements(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"k": 1, "name": "a"}\nnot json\n{"k": 2}\n')
    got = io.load_json(spark, str(tmp_path / "t.json"), "k long, name string, _errors string").cache()
    assert sorted((r.k or 0, r.name, r._errors) for r in got.collect()) == [(0, None, "not json"), (1, "a", None), (2, None, None)]
    page = "<html><head><style>p {}</style><script>var x = '<p>';</script></head><body><h1>A &amp; B</h1><p>one<br/>two</p></body></html>"
    df = spark.createDataFrame([(page,), ("",), (None,)], "t string")
    assert [r.t for r in io.extract_html(df, "t").collect()] == ["A & B one two", "", None]
    said = spark.createDataFrame([('{"a": ["x", 1, {"b": "y z"}], "c": -2.5, "d": null}',), ("{}",), (None,)], "t string")
    assert [r.t for r in io.extract_json(said, "t").collect()] == ["x 1 y z -2.5", "", None]
    said = spark.createDataFrame([('["a:", "q\\"r: 5\\"", "b\\\\c", "l\\nm", {"k:1" : "v"}, true, 7]',)], "t string")
    assert io.extract_json(said, "t").first().t == 'a: q"r: 5" b\\c l m v 7'
    table = {"ab": "1", "a": "2"}
    assert spark.range(1).select(X.normalize_table(F.lit("abac"), table).alias("x")).first().x == "12c"


def test_what_is_registered_can_be_taken_back(spark):
    df = spark.createDataFrame([(2,)], "n long")
    extensions.register_function("squared", lambda x: x * x)
    assert select(df, output_columns="squared(n)").records.first()[0] == 4 and "squared" in extensions.registered("function")
    extensions.unregister("function", "squared")
    with pytest.raises(S.SyntaxProblem):
        select(df, output_columns="squared(n)")
    with pytest.raises(ValueError):
        extensions.register("verb", "x", None)
