"""Registered queries of tables that refer to each other, of functions by script, text analysis, commands and extensions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from . import extensions
from .catalog import _POINTS, _RAD, _TF, _WORDS, _points, _rounded, _s, _t, query
from .functions import text as X, times
from .operators import facets, index
from .operators.select import range_filter, select
from .operators.tables import Table
from .sources import io, logical
from .sources.database import Database
from .streaming import windows as streams


def _tables(spark, d) -> dict[str, Table]:
    """The star schema with its references."""
    t = lambda name, key, **references: Table(_t(spark, d, name), key, references)
    return {
        "region": t("region", "r_regionkey"), "nation": t("nation", "n_nationkey", n_regionkey="region"), "customer": t("customer", "c_custkey", c_nationkey="nation"),
        "supplier": t("supplier", "s_suppkey", s_nationkey="nation"), "part": t("part", "p_partkey"), "orders": t("orders", "o_orderkey", o_custkey="customer"),
        "documents": t("documents", "doc_id"),
    }


def _ask(spark, d, name: str, **parameters):
    tables = _tables(spark, d)
    return select(tables[name], tables=tables, **parameters)


def _scratch(spark) -> str:
    """A folder of its own where driver and executors both write."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='lodestone-')}" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/catalog-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


# ---- accessors ------------------------------------------------------------------------------------
_CNR = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT c_custkey, n_name AS nation, r_name AS region FROM {_CNR} WHERE r_name <> 'ASIA' AND c_acctbal > 0 ORDER BY n_name DESC, c_acctbal, c_custkey LIMIT 40")
def accessor_filter_sort_output(spark, d):
    got = _ask(spark, d, "customer", filter='c_nationkey.n_regionkey.r_name != "ASIA" && c_acctbal > 0', sort_keys="-c_nationkey.n_name, c_acctbal", limit=40, output_columns="c_custkey, c_nationkey.n_name, c_nationkey.n_regionkey.r_name")
    return got.records.toDF("c_custkey", "nation", "region")


@query(f"SELECT r_name AS region, count(*) AS _nsubrecs, round(sum(c_acctbal), 2) AS _sum FROM {_CNR} GROUP BY 1")
def accessor_facet_key(spark, d):
    got = _ask(spark, d, "customer", drilldowns={"r": {"keys": "c_nationkey.n_regionkey.r_name", "calc_types": "SUM", "calc_target": "c_acctbal"}})
    return _rounded(got.drilldowns["r"].withColumnRenamed("c_nationkey.n_regionkey.r_name", "region"), _sum=2)


@query("SELECT n_nationkey AS _key, n_name, count(*) AS _nsubrecs FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY n_name LIMIT 12")
def facet_reference_key(spark, d):
    return _ask(spark, d, "customer", drilldowns={"n": {"keys": "c_nationkey", "sort_keys": "n_name", "limit": 12, "output_columns": "_key, n_name, _nsubrecs"}}).drilldowns["n"]


@query("SELECT o_orderkey, c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > c_acctbal * 20")
def accessor_in_arithmetic(spark, d):
    got = _ask(spark, d, "orders", filter="o_totalprice > o_custkey.c_acctbal * 20", output_columns="o_orderkey, o_custkey.c_name, o_custkey.c_nationkey.n_name")
    return got.records.toDF("o_orderkey", "customer", "nation")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS _id FROM customer ORDER BY _id DESC LIMIT 25")
def record_id_sort(spark, d):
    return _ask(spark, d, "customer", sort_keys="-_id", limit=25, output_columns="c_custkey, _id").records


@query("SELECT user_id, list_sort(list(n)) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) JOIN (SELECT event_type, length(event_type)::BIGINT AS n FROM events GROUP BY 1) USING (event_type) GROUP BY 1")
def accessor_vector(spark, d):
    kinds = _t(spark, d, "events").groupBy("event_type").agg(F.char_length("event_type").cast("long").alias("n"))
    users = _t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    got = select(Table(users, "user_id", {"kinds": "kinds"}), tables={"kinds": Table(kinds.select("event_type", "n"), "event_type")}, output_columns="user_id, kinds.n").records
    return got.toDF("user_id", "n").withColumn("n", F.array_sort("n"))


# ---- functions that ask other tables ---------------------------------------------------------------
@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0) AND o_totalprice > 100000")
def sub_filter_function(spark, d):
    return _ask(spark, d, "orders", filter='sub_filter(o_custkey, "c_mktsegment == \\"BUILDING\\" && c_acctbal > 0") && o_totalprice > 100000').records.select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def sub_filter_and_not(spark, d):
    return _ask(spark, d, "orders", filter='o_orderpriority == "1-URGENT" &! sub_filter(o_custkey, "c_acctbal > 0")').records.select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE contains(lower(n_name), '1')))")
def sub_filter_through_references(spark, d):
    return _ask(spark, d, "orders", filter='o_orderstatus == "P" || sub_filter(o_custkey.c_nationkey, "n_name @ \\"1\\"")').records.select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE (EXISTS (SELECT 1 FROM region WHERE p_size < r_regionkey * 5 AND p_retailprice > 900 + r_regionkey)) AND p_size % 2 = 0")
def in_records_function(spark, d):
    bounds = _t(spark, d, "region").select((F.col("r_regionkey") * 5).alias("size"), (F.col("r_regionkey") + 900).alias("price"))
    got = select(_t(spark, d, "part"), tables={"Bounds": bounds}, key="p_partkey", filter='in_records(Bounds, p_size, "LESS", "size", p_retailprice, "GREATER", "price") && p_size % 2 == 0')
    return got.records.select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def in_records_function_equal(spark, d):
    some = _t(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey")
    return select(_t(spark, d, "supplier"), tables={"Some": some}, key="s_suppkey", filter='in_records(Some, s_nationkey, "EQUAL", "_key")').records.select("s_suppkey")


@query("""WITH b AS (SELECT * FROM orders WHERE o_totalprice < 200000), n AS (SELECT count(*) FILTER (o_orderpriority = 'none') AS n1, count(*) FILTER (o_orderstatus = 'P') AS n2 FROM b)
SELECT o_orderkey FROM b, n WHERE o_orderpriority = 'none' OR (n1 <= 5 AND o_orderstatus = 'P') OR (n1 <= 5 AND n2 <= 2 AND true)""")
def escalate_function(spark, d):
    return _ask(spark, d, "orders", filter="o_totalprice < 200000 && escalate('o_orderpriority == \"none\"', 5, 'o_orderstatus == \"P\"', 2, 'true')").records.select("o_orderkey")


def _lexicon(spark, d):
    p = index.frequencies(_t(spark, d, "benchmark"), "item_id", "text")
    return p.select("token").distinct(), {"words": Table(p, "token")}


@query(f"""WITH w AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS token FROM benchmark), n AS (SELECT count(DISTINCT item_id) AS n FROM w)
SELECT token, round(count(*) / any_value(n.n), 8) AS ratio, array_to_string(list_sort(list(item_id)), ',') AS records FROM w, n GROUP BY 1 HAVING count(*) / any_value(n.n) BETWEEN 0.05 AND 0.5""")
def index_column_functions(spark, d):
    words, tables = _lexicon(spark, d)
    columns = {"ratio": {"stage": "filtered", "value": 'index_column_df_ratio("words")'}, "records": {"stage": "filtered", "value": 'index_column_source_records("words")'}}
    got = select(words, key="token", tables=tables, filter='index_column_df_ratio_between("words", 0.05, 0.5) && index_column_have_source_record("words")', columns=columns).records
    return _rounded(got.withColumn("records", F.array_join("records", ",")), ratio=8)


# ---- texts by script ------------------------------------------------------------------------------
@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def match_full_width(spark, d):
    return select(_t(spark, d, "documents"), filter='text @ "ＴＨＥ"').records.select("doc_id")


@query("SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text, '(the)', '<b>\\1</b>', 'gi'), '(and)', '<i>\\1</i>', 'gi'), '', '')) AS h FROM documents")
def highlight_tags(spark, d):
    got = select(_t(spark, d, "documents"), output_columns='doc_id, highlight(text, "the", "<b>", "</b>", "and", "<i>", "</i>")').records.toDF("doc_id", "h")
    return got.withColumn("h", F.md5(F.col("h").cast("binary")))


@query("SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '(the)', '[\\1]', 'gi')) AS h FROM documents")
def highlight_full(spark, d):
    got = select(_t(spark, d, "documents"), output_columns='doc_id, highlight_full(text, "NormalizerAuto", true, "the", "[", "]")').records.toDF("doc_id", "h")
    return got.withColumn("h", F.md5(F.col("h").cast("binary")))


@query("SELECT doc_id, md5(regexp_replace(text, '(the)', '<mark class=\"keyword-0\">\\1</mark>', 'gi')) AS h FROM documents WHERE contains(lower(text), 'the')")
def highlight_of_the_query(spark, d):
    got = select(_t(spark, d, "documents"), query="the", match_columns="text", output_columns='doc_id, highlight(text, {"sequential_class_tag_mode": true})').records.toDF("doc_id", "h")
    return got.withColumn("h", F.md5(F.col("h").cast("binary")))


_SNIP = "((?s:.{0,18}?)(?:[Tt][Hh][Ee]|[Aa][Nn][Dd])(?s:.{0,18}))"


@query(f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{_SNIP}')[1:2], lambda s: '<' || regexp_replace(ltrim(s), '(the|and)', '[\\1]', 'gi') || '>'), '|') AS snippets
FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'and')""")
def snippet_function(spark, d):
    said = 'snippet(text, "the", "[", "]", "and", "[", "]", {"width": 39, "max_n_results": 2, "prefix": "<", "suffix": ">"})'
    got = select(_t(spark, d, "documents"), filter='text @ "the" || text @ "and"', output_columns=f"doc_id, {said}").records.toDF("doc_id", "snippets")
    return got.withColumn("snippets", F.array_join("snippets", "|"))


@query("SELECT p_partkey, (3 - CASE WHEN colour = 'blue' THEN 1 ELSE least(levenshtein(colour, 'bleu'), 1 + levenshtein(colour, 'blue'), 1 + levenshtein(colour, 'lbeu'), 1 + levenshtein(colour, 'belu')) END)::DOUBLE AS _score FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS colour FROM part) WHERE least(levenshtein(colour, 'bleu'), 1 + levenshtein(colour, 'blue'), 1 + levenshtein(colour, 'lbeu'), 1 + levenshtein(colour, 'belu')) <= 2")
def fuzzy_score(spark, d):
    p = _t(spark, d, "part").withColumn("colour", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return select(p, filter='fuzzy_search(colour, "bleu", 2)', output_columns="p_partkey, _score").records


@query(f"""WITH p AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE lang = 'en')
SELECT doc_id FROM p, LATERAL (SELECT list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'and') AS b)
WHERE len(list_filter(a, lambda i: len(list_filter(b, lambda j: (j > i AND j - (i + 2) <= 3) OR (j < i AND i - (j + 1) <= 3))) > 0)) > 0""")
def match_near_phrase(spark, d):
    return select(_t(spark, d, "documents"), filter="""lang == "en" && text *NP3 '"of the" and'""").records.select("doc_id")


@query(f"""WITH p AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id FROM p, LATERAL (SELECT list_filter(range(1, len(w) + 1), lambda i: w[i] = 'that') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'for') AS b)
WHERE len(list_filter(a, lambda i: len(list_filter(b, lambda j: j > i AND j - i - 1 <= 4)) > 0)) > 0""")
def match_ordered_near_phrase(spark, d):
    return select(_t(spark, d, "documents"), filter='text *ONP4 "that for"').records.select("doc_id")


@query(f"""WITH p AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id FROM p, LATERAL (SELECT list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('that', 'this')) AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('for', 'not')) AS b)
WHERE len(list_filter(a, lambda i: len(list_filter(b, lambda j: greatest(i, j) - least(i, j) - 1 <= 2)) > 0)) > 0""")
def match_near_phrase_product(spark, d):
    return select(_t(spark, d, "documents"), filter='text *NPP2 "(that this) (for not)"').records.select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'of the') OR lang = 'fr'")
def query_phrase(spark, d):
    return select(_t(spark, d, "documents"), query='"of the" OR lang:fr', match_columns="text").records.select("doc_id")


@query("SELECT p_partkey FROM part WHERE starts_with(p_name, 'red') AND suffix(p_type, 'R') AND p_size >= 10 AND p_size <> 15 AND regexp_matches(p_brand, '#[1-3]$')")
def query_column_operators(spark, d):
    return select(_t(spark, d, "part"), query="p_name:^red p_type:$R p_size:>=10 p_size:!15 p_brand:~#[1-3]$").records.select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'blue') AND contains(lower(p_name), '-widget:x') OR contains(lower(p_name), 'red')")
def query_flags(spark, d):
    return select(_t(spark, d, "part"), query="(blue \\-widget\\:x) OR red", match_columns="p_name", query_flags="NONE").records.select("p_partkey")


@query("SELECT doc_id FROM documents")
def query_all(spark, d):
    return select(_t(spark, d, "documents"), query="*", match_columns="text").records.select("doc_id")


@query("SELECT doc_id FROM documents WHERE (lower(text) LIKE '%the%')::INT + (lower(text) LIKE '%and%')::INT + (lower(text) LIKE '%les%')::INT >= 2")
def query_quorum_operator(spark, d):
    return select(_t(spark, d, "documents"), query='*Q2"the and les"', match_columns="text").records.select("doc_id")


@query(f"SELECT doc_id, ({_TF.format('the')} + CASE WHEN contains(lower(text), 'and') THEN 3.0 * {_TF.format('and')} ELSE 0 END - CASE WHEN contains(lower(text), 'on') THEN {_TF.format('on')} ELSE 0 END)::DOUBLE AS _score FROM documents WHERE contains(lower(text), 'the')")
def score_adjust_operators(spark, d):
    return select(_t(spark, d, "documents"), filter='text @ "the" *> text @ "and" * 3 *< text @ "on"', output_columns="doc_id, _score").records


@query(f"""WITH t AS (SELECT doc_id, {_TF.format('the')} AS tf FROM documents), n AS (SELECT count(*) AS n, count(*) FILTER (tf > 0) AS df FROM t)
SELECT doc_id, round(greatest(tf * ln(n.n::DOUBLE / df), 1.0), 5) AS _score FROM t, n WHERE tf > 0""")
def scorer_tf_idf_function(spark, d):
    got = select(_t(spark, d, "documents"), filter='scorer_tf_idf(text, "the")', output_columns="doc_id, _score").records
    return _rounded(got, _score=5)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thean') OR ((SELECT count(*) FROM documents WHERE contains(lower(text), 'thean')) <= 3 AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])thean'))")
def match_escalation_parameter(spark, d):
    return select(_t(spark, d, "documents"), query="thean", match_columns="text", match_escalation="auto", match_escalation_threshold=3).records.select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'les')")
def query_expander_table(spark, d):
    synonyms = spark.createDataFrame([("article", ["the", "les"]), ("x", ["y"])], "word string, synonyms array<string>")
    return select(_t(spark, d, "documents"), query="Article", match_columns="text", query_expander=io.table_expander(synonyms, "word", "synonyms")).records.select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'los') OR contains(lower(text), 'las')")
def query_expander_tsv(spark, d):
    path = _scratch(spark)
    spark.createDataFrame([("# articles",), ("article\tlos\tlas",)], "value string").coalesce(1).write.text(path)
    expand = io.tsv_expander(spark, path)
    assert io.query_expand(expand, "an article OR x") == "an ((los) OR (las)) OR x"
    return select(_t(spark, d, "documents"), query="article", match_columns="text", query_expander=expand).records.select("doc_id")


# ---- expressions ----------------------------------------------------------------------------------
@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand WHEN p_name <> '' THEN p_name END AS said, p_size >= 10 AND p_brand <> 'Brand#1' AS both, CAST(p_size AS VARCHAR) AS size FROM part")
def value_and_or(spark, d):
    columns = {
        "said": {"stage": "output", "value": "(p_size > 25 && p_brand) || p_name"}, "both": {"stage": "output", "value": 'p_size >= 10 && p_brand != "Brand#1"'}, "size": {"stage": "output", "value": '(p_name, "" + p_size)'},
    }
    p = _t(spark, d, "part")
    got = select(p, columns={k: v for k, v in columns.items() if k != "said"}).records
    said = select(p.withColumn("big", F.when(F.col("p_size") > 25, F.col("p_brand"))), columns={"said": {"stage": "output", "value": "big || p_name"}}).records
    return got.join(said.select("p_partkey", "said"), "p_partkey").select("p_partkey", "said", "both", "size")


@query("SELECT p_partkey FROM part WHERE ((-p_size) >> 2) < -5 OR (p_size >> 1) = 7 OR (((p_size::BIGINT + 4294967296 - 50) % 4294967296) >> 28) = 15")
def filter_shifts(spark, d):
    return select(_t(spark, d, "part"), filter="((0 - p_size) >> 2) < -5 || (p_size >> 1) == 7 || ((p_size - 50) >>> 28) == 15").records.select("p_partkey")


@query("SELECT p_partkey, xor((((((p_size::BIGINT * 4 + 3 - 1) * 2) << 1) >> 2) & 1023) | 16, 5) AS _score FROM part WHERE p_size < 9")
def scorer_assignments(spark, d):
    steps = "_score = p_size * 4, _score += 3, _score--, _score *= 2, _score <<= 1, _score >>= 2, _score &= 1023, _score |= 16, _score ^= 5"
    got = select(_t(spark, d, "part"), filter="p_size < 9", scorer=steps, output_columns="p_partkey, _score").records
    return got.withColumn("_score", F.col("_score").cast("long"))


@query("SELECT c_custkey, seg <> 'MACHINERY' AS other, bal < 5 AS low FROM (SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS seg, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS bal FROM customer) WHERE seg <> 'MACHINERY' AND bal < 5")
def unset_reads_as_default(spark, d):
    c = _t(spark, d, "customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING"))).withColumn("bal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    columns = {"other": {"stage": "output", "value": 'seg != "MACHINERY"'}, "low": {"stage": "output", "value": "bal < 5"}}
    return select(c, filter='seg != "MACHINERY" && bal < 5', columns=columns).records.select("c_custkey", "other", "low")


@query("SELECT c_custkey, n_name AS first FROM customer, nation WHERE n_nationkey = 3 AND c_nationkey = 3")
def record_literal(spark, d):
    got = _ask(spark, d, "customer", filter='c_nationkey == nation["3"].n_nationkey', output_columns="c_custkey, nation[\"3\"].n_name").records
    return got.toDF("c_custkey", "first")


@query("SELECT vec_id, round(embedding[2]::DOUBLE, 6) AS second FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3)) > 0 AND len(embedding) > 4")
def vector_any_element(spark, d):
    got = select(_t(spark, d, "embeddings"), filter="embedding > 0.3 && vector_size(embedding) > 4", output_columns="vec_id, embedding[1]").records.toDF("vec_id", "second")
    return got.withColumn("second", F.round(F.col("second").cast("double"), 6))


@query("SELECT p_partkey, greatest(p_size::DOUBLE, p_retailprice / 100, 12.0) AS hi, least(p_size, 20)::BIGINT AS lo, levenshtein(p_brand, 'Brand#1')::BIGINT AS edits FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') OR p_size = 3")
def functions_by_script(spark, d):
    columns = {"hi": {"stage": "output", "value": "max(p_size, p_retailprice / 100, 12.0)", "type": "double"}, "lo": {"stage": "output", "value": "min(p_size, 20)", "type": "bigint"}, "edits": {"stage": "output", "value": 'edit_distance(p_brand, "Brand#1")', "type": "bigint"}}
    got = select(_t(spark, d, "part"), filter='all_records() && (query_parallel_or("p_name", "red", "blue") || query("p_size", "p_size:3"))', columns=columns).records
    return got.select("p_partkey", "hi", "lo", "edits")


@query("SELECT event_id, strftime(ts, '100%% of %Y') AS t, list_transform([ts, ts + INTERVAL 40 DAY], lambda x: strftime(date_trunc('month', x), '%Y-%m-%d')) AS months FROM events")
def time_percent_and_vectors(spark, d):
    t = F.col("ts")
    months = F.transform(times.each(F.array(t, t + F.expr("INTERVAL 40 DAYS")), times.classify_month), lambda x: _s(x, "yyyy-MM-dd"))
    return _t(spark, d, "events").select("event_id", times.format(t, "100%% of %Y").alias("t"), months.alias("months"))


# ---- sorting --------------------------------------------------------------------------------------
@query("SELECT p_partkey FROM part ORDER BY length(p_name) DESC, p_size % 7, p_partkey LIMIT 30")
def sort_by_expressions(spark, d):
    return _ask(spark, d, "part", sort_keys="-string_length(p_name), p_size % 7", limit=30, output_columns="p_partkey").records


@query(f"SELECT c_custkey FROM {_POINTS} ORDER BY sqrt(pow({_RAD.format('lon - 1000000')} * cos({_RAD.format('(lat + 2000000) / 2.0')}), 2) + pow({_RAD.format('lat - 2000000')}, 2)) * 6357303, c_custkey LIMIT 20")
def sort_by_geo_distance(spark, d):
    return select(_points(spark, d), key="c_custkey", sort_keys='geo_distance(place, "2000000x1000000")', limit=20, output_columns="c_custkey").records


@query("SELECT c_custkey, round(6357303 * abs(radians((648000000 * 2 - 1000000 - (c_custkey % 1000) * 1000 + 0.0 - 648000000 * 2) / 3600000.0)), 1) AS metres FROM customer")
def geo_over_date_line(spark, d):
    west = F.concat(F.lit("0x"), (647500000 - (F.col("c_custkey") % 1000) * 1000).cast("string"))
    got = select(_t(spark, d, "customer").withColumn("west", west), output_columns='c_custkey, geo_distance(west, "0x-647500000")').records.toDF("c_custkey", "metres")
    return _rounded(got, metres=1)


# ---- facets in stages ----------------------------------------------------------------------------------
@query("""SELECT l_returnflag, n AS _nsubrecs, round(total, 2) AS total, round(total / n, 4) AS mean, round(total / n, 4) > 25 AS high FROM (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1) WHERE n > 10""")
def facet_stages(spark, d):
    columns = {
        "total": {"stage": "group", "value": "aggregator_sum(l_quantity)"}, "size": {"stage": "initial", "value": "_nsubrecs * 1"}, "mean": {"stage": "filtered", "value": "number_round(total / _nsubrecs, 4)"},
        "high": {"stage": "output", "value": "mean > 25"},
    }
    got = select(_t(spark, d, "lineitem"), drilldowns={"f": {"keys": "l_returnflag", "columns": columns, "filter": "size > 10", "output_columns": "l_returnflag, _nsubrecs, total, mean, high"}}).drilldowns["f"]
    return _rounded(got, total=2)


@query("SELECT (floor(p_size / 10) * 10)::BIGINT AS decade, count(*) AS _nsubrecs FROM part GROUP BY 1")
def facet_expression_key(spark, d):
    got = select(_t(spark, d, "part"), drilldowns={"f": {"keys": "number_classify(p_size, 10)"}}).drilldowns["f"].toDF("decade", "_nsubrecs")
    return got.withColumn("decade", F.col("decade").cast("long"))


# ---- text analysis ----------------------------------------------------------------------------------
@query("SELECT doc_id, md5(lower(text)) AS h FROM documents WHERE text IS NOT NULL")
def normalize_nfkc(spark, d):
    docs = _t(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(X.normalize(F.col("text"), "NormalizerNFKC").cast("binary")).alias("h"))


@query("SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '\\s+', '', 'g')) AS h FROM documents WHERE text IS NOT NULL")
def normalize_options(spark, d):
    x = X.normalize(F.col("text"), "NormalizerNFKC150", unify_latin_alphabet_with=True, remove_blank=True)
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.md5(x.cast("binary")).alias("h"))


@query(f"SELECT item_id, array_to_string(list_filter({_WORDS}, lambda w: w NOT IN ('the', 'of', 'and')), ' ') AS words FROM benchmark")
def token_filter_stop_words(spark, d):
    words = X.token_filter(X.tokenize(F.col("text")), "TokenFilterStopWord", words=["the", "of", "and"])
    return _t(spark, d, "benchmark").select("item_id", F.array_join(words, " ").alias("words"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: x <> ''), '|') AS delimited, array_to_string(regexp_extract_all(lower(p_type), '[aeiou]+'), '|') AS vowels FROM part")
def tokenize_delimit_and_pattern(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(X.tokenize(F.col("p_name"), "TokenDelimit"), "|").alias("delimited"), F.array_join(X.tokenize(F.col("p_type"), "TokenPattern", pattern="[aeiou]+"), "|").alias("vowels"))


@query("SELECT p_partkey, array_to_string(list_transform(range(1, length(p_brand) + 1), lambda i: substr(lower(p_brand), i, 2)), '|') AS grams FROM part")
def tokenize_bigram_split(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(X.tokenize(F.col("p_brand"), "TokenBigramSplitSymbolAlphaDigit"), "|").alias("grams"))


@query(f"""WITH t AS (SELECT item_id AS key, {_WORDS} AS w FROM benchmark), p AS (SELECT key, token, count(*) AS tf FROM (SELECT key, unnest(w) AS token FROM t) GROUP BY ALL), f AS (SELECT token, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM t),
v AS (SELECT key, token, tf * ln(n.n / df) AS x FROM p JOIN f USING (token), n)
SELECT key, token, round(CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY key)) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY key)) ELSE 0 END, 5) + 0.0 AS weight FROM v""")
def vector_tf_idf(spark, d):
    got = index.tf_idf_vectors(_t(spark, d, "benchmark"), "item_id", "text")
    return got.withColumn("weight", F.round("weight", 5) + 0.0)


@query(f"WITH p AS (SELECT item_id AS key, len(list_filter({_WORDS}, lambda x: x = 'the')) AS a, len(list_filter({_WORDS}, lambda x: x = 'of')) AS b FROM benchmark) SELECT key, (a + b)::BIGINT AS _score FROM p WHERE a > 0 OR b > 0")
def search_written_index(spark, d):
    path = _scratch(spark)
    index.write(index.postings(_t(spark, d, "benchmark"), "item_id", "text"), path, buckets=16)
    got = index.search(spark.read.parquet(path), ["the", "of"], every=False, buckets=16)  # reads two buckets at most
    return got.select("key", F.col("_score").cast("long").alias("_score"))


# ---- loading, commands, outputs -------------------------------------------------------------------------
@query("SELECT id, n, name, n * 2 AS twice FROM (VALUES (1, 10, 'a'), (2, 5, 'b2'), (3, 7, 'c'), (4, NULL, 'd')) t(id, n, name)")
def load_command(spark, d):
    db = Database(spark)
    db.table_create("T", "id long, n long, name string, twice long", key="id")
    db.load("T", [["id", "n", "name"], [1, 10, "a"], [2, 5, "b"], [3, 7, "c"]], each={"twice": "n * 2"})
    db.load("T", [{"id": 2, "name": "b2"}, {"id": 1, "name": "refused"}], if_exists="n < 10")
    got = db.load("T", [("4", "many", "d")], columns="id, n, name", output_ids=True, output_errors=True)
    assert [tuple(r) for r in got.ids.collect()] == [(4,)] and [tuple(r) for r in got.errors.collect()] == [("4", "n", "many")]
    return db["T"].df


@query("SELECT n_nationkey, n_name, n_regionkey, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 4 AND n_regionkey <> 2")
def table_commands(spark, d):
    db = Database(spark, {k: v for k, v in _tables(spark, d).items() if k in ("nation", "region")})
    db.table_copy("nation", "countries")
    db.table_remove("nation")
    db.table_rename("countries", "nation")
    db.column_create("nation", "copied", "string", value="n_name")
    db.column_rename("nation", "copied", "said")
    db.column_remove("nation", "said")
    db.delete("nation", key=4)
    db.delete("nation", filter="n_regionkey == 2")
    assert db.object_exist("nation.n_name") and not db.object_exist("countries") and [r.name for r in db.table_list().collect()] == ["nation", "region"]
    assert {r.name: r.kind for r in db.column_list("nation").collect()}["n_nationkey"] == "key" and "n_name" in db.schema()["nation"]["columns"]
    return db["nation"].df.join(_t(spark, d, "region").select("r_regionkey", F.col("r_name").alias("region_name")), F.col("n_regionkey") == F.col("r_regionkey")).drop("r_regionkey")


@query("SELECT c_custkey AS id, upper(c_name) AS said, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000")
def select_load_table(spark, d):
    db = Database(spark, _tables(spark, d))
    db.table_create("Rich", "id long, said string, balance double", key="id")
    db.tables["customer"].df = db["customer"].df.withColumn("loud", F.upper("c_name"))
    db.select("customer", filter="c_acctbal > 5000", load_table="Rich", load_columns="id, said, balance", load_values="c_custkey, loud, c_acctbal")
    return db["Rich"].df


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def select_result_cache(spark, d):
    db = Database(spark, _tables(spark, d), cache_limit=2)
    first = db.select("customer", cache="yes", filter="c_acctbal > 9000", output_columns="c_custkey")
    assert db.select("customer", cache="yes", filter="c_acctbal > 9000", output_columns="c_custkey") is first and db.cache_limit(1) == 2
    return first.records


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 90000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 3")
def range_filter_command(spark, d):
    return range_filter(_tables(spark, d)["orders"], "o_totalprice", 1000.0, 90000.0, "exclude", "include", "descending", 3, 15, filter='o_orderstatus == "F"', output_columns="o_orderkey, o_totalprice")


@query("""SELECT '<HIT><FIELD NAME="n_nationkey">' || n_nationkey || '</FIELD><FIELD NAME="said">' || '&lt;' || n_name || '&gt;' || '</FIELD><VECTOR NAME="v"><ELEMENT>' || n_nationkey || '</ELEMENT><ELEMENT>' || n_regionkey || '</ELEMENT></VECTOR></HIT>' AS value FROM nation""")
def output_xml(spark, d):
    return io.to_xml(_t(spark, d, "nation").select("n_nationkey", F.concat(F.lit("<"), "n_name", F.lit(">")).alias("said"), F.array("n_nationkey", "n_regionkey").alias("v")))


@query("SELECT lower(hex(encode(chr(146)))[5:] || '92') || lpad(lower(to_hex(r_regionkey)), 2, '0') || lower(to_hex(160 + length(r_name))) || lower(hex(encode(r_name))) AS h FROM region")
def output_message_pack(spark, d):
    return io.to_message_pack(_t(spark, d, "region").select("r_regionkey", "r_name")).select(F.lower(F.hex("value")).alias("h"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS said FROM events")
def extract_json_text(spark, d):
    return io.extract_json(_t(spark, d, "events").select("event_id", F.col("props").alias("said")), "said")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def dump_and_restore(spark, d):
    path, nation = _scratch(spark), _t(spark, d, "nation")
    assert Database(spark, {"nation": nation}).dump(path).startswith("CREATE TABLE nation")
    return io.restore(spark, path, "nation", nation.schema)


# ---- logical tables that are written --------------------------------------------------------------------
def _written(spark, d) -> str:
    path = _scratch(spark)
    logical.write(_t(spark, d, "events"), path, "ts")
    return path


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06 12:00:00' AND event_type = 'click'")
def logical_pruned_partitions(spark, d):
    inside = logical.within(logical.read(spark, _written(spark, d)), "ts", "2024-01-05", "2024-01-06T12:00:00")
    assert len(inside.inputFiles()) == 0 or {re.search(r"shard=(\d+)", f)[1] for f in inside.inputFiles()} >= {"20240105"}
    return select(inside, filter='event_type == "click"').records.select("event_id")


@query("SELECT event_id FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-03 06:00:00' AND ts < TIMESTAMP '2024-01-08')")
def logical_remove_in_place(spark, d):
    path = _written(spark, d)
    logical.remove_in_place(spark, path, "ts", "2024-01-03T06:00:00", "2024-01-08", most_border="exclude")
    return logical.read(spark, path).select("event_id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND value > 20 ORDER BY ts, event_id LIMIT 60")
def logical_stream_output(spark, d):
    rows = list(logical.stream(logical.read(spark, _written(spark, d)), "ts", "2024-01-09", filter="value > 20", limit=60, key="event_id"))
    return spark.createDataFrame([(r.event_id, r.ts) for r in rows], "event_id long, ts timestamp").select("event_id", _s("ts").alias("t"))


@query("SELECT strftime(ts, '%Y%m%d') AS shard, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-04 23:59:59' GROUP BY 1")
def logical_each_shard(spark, d):
    each = logical.each_shard(logical.read(spark, _written(spark, d)), "ts", lambda x: x.where("_neighbour = 0").count(), "2024-01-02", "2024-01-04T23:59:59", ahead=1, behind=1)
    return spark.createDataFrame(list(each), "shard string, n long")


@query("WITH p AS (SELECT event_type AS item, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) SELECT item, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2")
def suggest_learner_stream(spark, d):
    events, path = _t(spark, d, "events"), _scratch(spark)
    events.coalesce(1).write.parquet(f"{path}/in")
    streams.learn(streams.read(spark, f"{path}/in", events), "user_id", "event_id", "event_type", f"{path}/out", f"{path}/state").awaitTermination()
    return streams.learned(spark, f"{path}/out")


# ---- extensions ---------------------------------------------------------------------------------------
@query("SELECT p_partkey, p_size * 3 + 1 AS y FROM part WHERE p_size % 2 = 0 ORDER BY p_size % 5 DESC, p_partkey LIMIT 50")
def extension_functions(spark, d):
    extensions.register_function("triple", lambda x: x * 3)
    extensions.register_selector("is_even", lambda x: x % 2 == 0)
    extensions.register_applier("and_one", lambda x: x + 1)
    extensions.register_sorter("by_rest", lambda x: x % 5)
    columns = {"y": {"stage": "output", "value": "and_one(triple(p_size))"}}
    got = select(_t(spark, d, "part"), key="p_partkey", filter="is_even(p_size)", columns=columns, sort_keys="-by_rest(p_size)", limit=50).records
    return got.select("p_partkey", "y")


@query("SELECT o_orderstatus, count(*) AS _nsubrecs, round(max(o_totalprice) - min(o_totalprice), 2) AS span FROM orders GROUP BY 1")
def extension_aggregator(spark, d):
    extensions.register_aggregator("aggregator_span", lambda x: F.round(F.max(x) - F.min(x), 2))
    return facets.drilldown(_t(spark, d, "orders"), "o_orderstatus", columns={"span": {"stage": "group", "value": "aggregator_span(o_totalprice)"}})


@query("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def extension_window_function(spark, d):
    from pyspark.sql import Window

    extensions.register_window_function("window_lag", lambda w, x: F.lag(x).over(Window.partitionBy(*w.group_keys).orderBy(*w.sort_keys, *w.tie)))
    columns = {"before": {"stage": "filtered", "value": "window_lag(event_type)", "window_group_keys": "user_id", "window_sort_keys": "ts"}}
    return select(_t(spark, d, "events"), key="event_id", columns=columns).records.select("event_id", "before")


@query(f"SELECT doc_id, sqrt({_TF.format('the')}::DOUBLE) AS _score FROM documents WHERE contains(lower(text), 'the')")
def extension_scorer(spark, d):
    extensions.register_scorer("scorer_root", lambda tf, *_: F.sqrt(tf))
    return select(_t(spark, d, "documents"), filter='scorer_root(text, "the")', output_columns="doc_id, _score").records


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, 'e', '3'), ' '), lambda t: reverse(t)), lambda t: length(t) > 3), '|') AS said FROM part")
def extension_text(spark, d):
    extensions.register_normalizer("NormalizerLeet", lambda x, **_: F.replace(x, F.lit("e"), F.lit("3")))
    extensions.register_tokenizer("TokenReversed", lambda x, **_: F.transform(F.split(x, " "), F.reverse))
    extensions.register_token_filter("TokenFilterLong", lambda t, **o: F.filter(t, lambda x: F.char_length(x) > o["least"]))
    tokens = X.token_filter(X.tokenize(X.normalize(F.col("p_name"), "NormalizerLeet"), "TokenReversed"), "TokenFilterLong", least=3)
    return _t(spark, d, "part").select("p_partkey", F.array_join(tokens, "|").alias("said"))


@query("SELECT count(*) AS n FROM orders")
def extension_command(spark, d):
    extensions.register_command("how_many", lambda db, table: db[table].df.agg(F.count("*").alias("n")))
    return Database(spark, _tables(spark, d)).command("how_many", table="orders")
