"""The registered queries of the library's own operators, with the SQL they are held against.

Doubles are rounded on both sides, times are given as strings, counts as longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import geo, scalar as A, text as X, times
from .operators import facets, index, joins, windows
from .operators.select import escalate, select
from .sources import io, logical
from .streaming import windows as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; sql: the same for DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _s(x, pattern="yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(x, pattern)


# ---- facets ---------------------------------------------------------------------------------------
_CALC = "count(*) AS _nsubrecs, round(max(o_totalprice), 2) AS _max, round(min(o_totalprice), 2) AS _min, round(sum(o_totalprice), 2) AS _sum, round(avg(o_totalprice), 4) AS _mean"


def _rounded(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


@query(f"SELECT o_orderpriority, {_CALC} FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def facet_calc_types(spark, d):
    got = select(_t(spark, d, "orders"), filter='o_orderstatus == "F"', drilldowns={"p": {"keys": "o_orderpriority", "calc_types": "MAX,MIN,SUM,MEAN", "calc_target": "o_totalprice"}})
    return _rounded(got.drilldowns["p"], _max=2, _min=2, _sum=2, _mean=4)


@query("SELECT l_returnflag, l_linestatus, count(*) AS _nsubrecs, round(sum(l_quantity), 2) AS _sum FROM lineitem GROUP BY 1, 2")
def facet_multi_key(spark, d):
    return _rounded(facets.drilldown(_t(spark, d, "lineitem"), "l_returnflag, l_linestatus", "SUM", "l_quantity"), _sum=2)


@query("SELECT l_suppkey, count(*) AS _nsubrecs FROM lineitem GROUP BY 1 HAVING count(*) > 5 ORDER BY _nsubrecs DESC, l_suppkey LIMIT 10 OFFSET 2")
def facet_filter_sort_limit(spark, d):
    return facets.drilldown(_t(spark, d, "lineitem"), "l_suppkey", filter="_nsubrecs > 5", sort_keys="-_nsubrecs", offset=2, limit=10)


@query("SELECT n_regionkey, count(*) AS _nsubrecs FROM (SELECT DISTINCT c_nationkey FROM customer) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def facet_chained(spark, d):
    nations = facets.drilldown(_t(spark, d, "customer"), "c_nationkey")
    return facets.chained(nations, _t(spark, d, "nation"), "c_nationkey", "n_nationkey", "n_regionkey")


_TAGS = "SELECT DISTINCT user_id, event_type FROM events"


@query(f"""WITH t AS ({_TAGS}), g AS (SELECT user_id, list_sort(list(event_type)) AS tags FROM t GROUP BY 1),
s AS (SELECT unnest(list_filter([list_filter(tags, lambda x, i: (m >> (i - 1)) & 1 = 1) for m in range(1, 1 << len(tags))], lambda x: true)) AS tags FROM g)
SELECT array_to_string(tags, ',') AS tags, count(*) AS _nsubrecs FROM s GROUP BY 1""")
def facet_power_set(spark, d):
    users = _t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return facets.drilldown(users, "tags", key_vector_expansion="POWER_SET").select(F.array_join("tags", ",").alias("tags"), "_nsubrecs")


@query(f"SELECT event_type AS tags, count(*) AS _nsubrecs FROM ({_TAGS}) GROUP BY 1")
def facet_vector_key(spark, d):
    users = _t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return facets.drilldown(users, "tags")


@query("SELECT o_orderstatus, count(*) AS _nsubrecs FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100) GROUP BY 1")
def facet_target_limit(spark, d):
    return facets.drilldown(_t(spark, d, "orders"), "o_orderstatus", max_n_target_records=100, order="o_orderkey")


@query("SELECT o_orderstatus, count(*) AS _nsubrecs FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT (SELECT greatest(count(*) - 50 + 1, 0) FROM orders)) GROUP BY 1")
def facet_target_limit_negative(spark, d):
    return facets.drilldown(_t(spark, d, "orders"), "o_orderstatus", max_n_target_records=-50, order="o_orderkey")


@query("""SELECT 'l_returnflag' AS facet, l_returnflag AS key, count(*) AS _nsubrecs FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_discount', l_discount::VARCHAR, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_tax', l_tax::VARCHAR, count(*) FROM lineitem GROUP BY 2""")
def facet_many_one_scan(spark, d):
    return facets.many(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"])


@query("SELECT o_orderpriority, count(*) AS _nsubrecs, (count(*) + CASE WHEN o_orderpriority = '1-URGENT' THEN 10 ELSE 0 END)::DOUBLE AS _score FROM orders GROUP BY 1 ORDER BY _score DESC, 1 LIMIT 3")
def facet_adjuster(spark, d):
    return facets.drilldown(_t(spark, d, "orders"), "o_orderpriority", adjuster='o_orderpriority == "1-URGENT" * 10', sort_keys="-_score", limit=3)


@query("SELECT l_linenumber, count(*) AS _nsubrecs, count(*) * 2 + l_linenumber AS weighted FROM lineitem GROUP BY 1 HAVING count(*) * 2 + l_linenumber > 100")
def facet_columns(spark, d):
    return facets.drilldown(_t(spark, d, "lineitem"), "l_linenumber", columns={"weighted": "_nsubrecs * 2 + l_linenumber"}, filter="weighted > 100")


@query("""SELECT l_returnflag, count(*) AS _nsubrecs, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice), 3) AS mean, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY 1""")
def agg_sum_mean_sd(spark, d):
    aggs = {"total": F.round(facets.aggregator_sum("l_quantity"), 2), "mean": F.round(facets.aggregator_mean("l_extendedprice"), 3), "sd": F.round(facets.aggregator_sd("l_quantity"), 6)}
    return facets.drilldown(_t(spark, d, "lineitem"), "l_returnflag", aggregates=aggs)


@query("SELECT l_orderkey, count(*) AS _nsubrecs, coalesce(round(stddev_samp(l_quantity), 6), -1) AS sd FROM lineitem GROUP BY 1")
def agg_sd_unbiased(spark, d):
    sd = facets.aggregator_sd("l_quantity", unbiased=True)
    return facets.drilldown(_t(spark, d, "lineitem"), "l_orderkey", aggregates={"sd": F.when(F.isnan(sd), -1.0).otherwise(F.round(sd, 6))})


@query("SELECT label, count(*) AS _nsubrecs, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))) / sum(len(embedding)), 6) AS _mean FROM embeddings GROUP BY 1")
def facet_vector_target(spark, d):
    e = _t(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return _rounded(facets.drilldown(e, "label", "MEAN", "v"), _mean=6)


# ---- conditions -----------------------------------------------------------------------------------
def _filter(name, script, sql, key, extra=()):
    def f(spark, d):
        return select(_t(spark, d, name), filter=script).records.select(key, *extra)

    return query(f"SELECT {', '.join([key, *extra])} FROM {name} WHERE {sql}")(f)


for _n, _table, _script, _sql, _key in (
    ("filter_and_not", "orders", 'o_orderstatus == "F" &! o_orderpriority @ "urgent"', "o_orderstatus = 'F' AND NOT lower(o_orderpriority) LIKE '%urgent%'", "o_orderkey"),
    ("filter_in_values", "part", 'in_values(p_brand, "Brand#1", "Brand#2") && p_size < 20', "p_brand IN ('Brand#1', 'Brand#2') AND p_size < 20", "p_partkey"),
    ("filter_between_borders", "orders", 'between(o_totalprice, 1000, "exclude", 100000, "include")', "o_totalprice > 1000 AND o_totalprice <= 100000", "o_orderkey"),
    ("filter_bitops", "part", "(p_size & 6) == 2 || (p_size ^ 3) > 40 || (p_size << 2) == 16 || (p_size | 1) == 31", "(p_size & 6) = 2 OR xor(p_size, 3) > 40 OR (p_size << 2) = 16 OR (p_size | 1) = 31", "p_partkey"),
    ("filter_arithmetic", "part", "p_size / 4 == 2 && p_size % 3 != 0 && -p_size + 20 > 5", "p_size // 4 = 2 AND p_size % 3 <> 0 AND -p_size + 20 > 5", "p_partkey"),
    ("filter_prefix_suffix", "part", 'p_name @^ "red" || p_name @$ "ring"', "starts_with(p_name, 'red') OR suffix(p_name, 'ring')", "p_partkey"),
    ("filter_regexp", "part", r'p_name @~ "\\A(red|blue) [a-w]+\\z"', r"regexp_full_match(p_name, '(red|blue) [a-w]+')", "p_partkey"),
    ("filter_not", "customer", '!(c_mktsegment == "BUILDING" || c_acctbal < 0)', "NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)", "c_custkey"),
    ("filter_time", "orders", 'o_orderdate >= "1997-01-01" && o_orderdate < "1998-01-01"', "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'", "o_orderkey"),
    ("filter_functions", "part", "string_length(p_name) > 9 && number_classify(p_size, 10) == 20", "length(p_name) > 9 AND floor(p_size / 10) * 10 = 20", "p_partkey"),
    ("filter_quorum", "documents", 'text *Q2 "the and zwischen"', "(lower(text) LIKE '%the%')::INT + (lower(text) LIKE '%and%')::INT + (lower(text) LIKE '%zwischen%')::INT >= 2", "doc_id"),
    ("filter_term_extract", "part", 'p_type *T "an economy of standard size"', "contains('an economy of standard size', lower(p_type)) AND p_type <> ''", "p_partkey"),
):
    _f = _filter(_table, _script, _sql, _key)
    del QUERIES[_f.__name__]
    ORACLE_SQL[_n] = ORACLE_SQL.pop(_f.__name__)
    QUERIES[_n] = _f


# ---- select: stages, pages, slices ------------------------------------------------------------------
@query("""SELECT o_orderkey, big, rank_, big * 2 + o_orderkey AS final FROM (
SELECT o_orderkey, floor(o_totalprice / 1000)::BIGINT AS big, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS rank_ FROM orders WHERE floor(o_totalprice / 1000) > 100)
WHERE rank_ <= 5""")
def stage_initial_filtered_output(spark, d):
    columns = {
        "big": {"stage": "initial", "value": "number_classify(o_totalprice, 1000) / 1000", "type": "bigint"},
        "rank_": {"stage": "filtered", "value": "window_rank()", "window_group_keys": "o_orderstatus", "window_sort_keys": "-o_totalprice"},
        "final": {"stage": "output", "value": "big * 2 + o_orderkey"},
    }
    got = select(_t(spark, d, "orders"), filter="big > 100", columns=columns, post_filter="rank_ <= 5", key="o_orderkey").records
    return got.select("o_orderkey", "big", F.col("rank_").cast("long").alias("rank_"), "final")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7 OFFSET 20")
def sort_offset_limit(spark, d):
    return select(_t(spark, d, "customer"), sort_keys="-c_acctbal", offset=20, limit=7, key="c_custkey", output_columns="c_custkey, c_name, c_acctbal").records


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET (SELECT count(*) - 12 FROM customer)")
def negative_offset(spark, d):
    return select(_t(spark, d, "customer"), sort_keys="c_custkey", offset=-12, limit=5, key="c_custkey", output_columns="c_custkey").records


@query("""SELECT 'urgent' AS slice, o_orderstatus, count(*) AS _nsubrecs FROM orders WHERE o_totalprice > 200000 AND o_orderpriority = '1-URGENT' GROUP BY 2
UNION ALL SELECT 'low', o_orderstatus, count(*) FROM orders WHERE o_totalprice > 200000 AND o_orderpriority = '5-LOW' GROUP BY 2""")
def slices(spark, d):
    facet = {"s": {"keys": "o_orderstatus"}}
    said = {"urgent": {"filter": 'o_orderpriority == "1-URGENT"', "drilldowns": facet}, "low": {"filter": 'o_orderpriority == "5-LOW"', "drilldowns": facet}}
    got = select(_t(spark, d, "orders"), filter="o_totalprice > 200000", slices=said)
    a, b = (got.slices[k].drilldowns["s"].select(F.lit(k).alias("slice"), "o_orderstatus", "_nsubrecs") for k in said)
    return a.unionByName(b)


@query("SELECT p_partkey, (p_size * 2 + 1)::BIGINT AS _score FROM part WHERE p_size > 40 ORDER BY _score DESC, p_partkey LIMIT 20")
def scorer_expression(spark, d):
    got = select(_t(spark, d, "part"), filter="p_size > 40", scorer="_score = p_size * 2 + 1", sort_keys="-_score", limit=20, key="p_partkey", output_columns="p_partkey, _score").records
    return got.withColumn("_score", F.col("_score").cast("long"))


_TF = "(length(lower(text)) - length(replace(lower(text), '{0}', ''))) // length('{0}')"


@query(f"SELECT doc_id, ({_TF.format('the')} + CASE WHEN contains(lower(text), 'and') THEN {_TF.format('and')} * 3.0 ELSE 0 END)::DOUBLE AS _score FROM documents WHERE contains(lower(text), 'the')")
def adjuster(spark, d):
    return select(_t(spark, d, "documents"), filter='text @ "the"', adjuster='text @ "and" * 3', output_columns="doc_id, _score", key="doc_id").records


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_keys(spark, d):
    return facets.drilldown(_t(spark, d, "customer"), "c_mktsegment", output_columns="c_mktsegment")


# ---- windows --------------------------------------------------------------------------------------
@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events")
def win_record_number(spark, d):
    return _t(spark, d, "events").select("event_id", windows.record_number("event_type", "ts", ["event_id"]).cast("long").alias("n"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders")
def win_rank(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", windows.rank("o_custkey", "o_orderpriority").cast("long").alias("r"))


@query("SELECT o_orderkey, 1::BIGINT AS r FROM orders")
def win_rank_group_only(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", windows.rank("o_orderstatus").cast("long").alias("r"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS s FROM events")
def win_sum_running(spark, d):
    return _t(spark, d, "events").select("event_id", F.round(windows.window_sum("value", "user_id", "ts", ["event_id"]), 4).alias("s"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id), 4) AS s FROM events")
def win_sum_total(spark, d):
    return _t(spark, d, "events").select("event_id", F.round(windows.window_sum("value", "user_id"), 4).alias("s"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def win_count_running(spark, d):
    return _t(spark, d, "events").select("event_id", windows.window_count("user_id", "-ts", ["event_id"]).alias("n"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def win_count_total(spark, d):
    return _t(spark, d, "events").select("event_id", windows.window_count("user_id").alias("n"))


# ---- functions of times ---------------------------------------------------------------------------
def _time(name, column, sql):
    def f(spark, d):
        return facets.drilldown(_t(spark, d, "events").select(_s(column(F.col("ts"))).alias("t")), "t")

    QUERIES[name] = f
    ORACLE_SQL[name] = f"SELECT strftime({sql}, '%Y-%m-%d %H:%M:%S') AS t, count(*) AS _nsubrecs FROM events GROUP BY 1"


_time("time_classify_second", lambda t: times.classify_second(t, 10), "time_bucket(INTERVAL 10 SECOND, ts)")
_time("time_classify_minute", lambda t: times.classify_minute(t, 15), "time_bucket(INTERVAL 15 MINUTE, ts)")
_time("time_classify_hour", lambda t: times.classify_hour(t, 6), "date_trunc('day', ts) + INTERVAL 1 HOUR * (hour(ts) // 6 * 6)")
_time("time_classify_day", times.classify_day, "date_trunc('day', ts)")
_time("time_classify_week", times.classify_week, "date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY")
_time("time_classify_month", lambda t: times.classify_month(t, 3), "date_trunc('quarter', ts)")
_time("time_classify_year", lambda t: times.classify_year(t, 10), "make_date(year(ts)::INT // 10 * 10, 1, 1)::TIMESTAMP")


@query("SELECT dayofweek(ts)::BIGINT AS dow, count(*) AS _nsubrecs FROM events GROUP BY 1")
def time_classify_day_of_week(spark, d):
    return facets.drilldown(_t(spark, d, "events").select(times.day_of_week(F.col("ts")).cast("long").alias("dow")), "dow")


@query("SELECT event_id, strftime(ts, '%Y/%m/%d at %H:%M') AS t, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def time_format(spark, d):
    return _t(spark, d, "events").select("event_id", times.format(F.col("ts"), "%Y/%m/%d at %H:%M").alias("t"), F.substr(times.format_iso8601(F.col("ts").cast("timestamp")), F.lit(1), F.lit(26)).alias("iso"))


# ---- functions of numbers, strings, vectors -----------------------------------------------------------
@query("SELECT c_custkey, (floor(c_acctbal / 500) * 500)::DOUBLE AS k FROM customer")
def number_classify_negative(spark, d):
    return _t(spark, d, "customer").select("c_custkey", A.number_classify(F.col("c_acctbal"), 500).cast("double").alias("k"))


@query("SELECT c_custkey, round(c_acctbal) + 0.0 AS r0, round(c_acctbal, -2) + 0.0 AS r2, abs(c_acctbal) AS a, greatest(c_acctbal, c_nationkey::DOUBLE, 7.0) AS hi, least(c_acctbal, c_nationkey::DOUBLE) AS lo FROM customer")
def number_functions(spark, d):
    x = F.col("c_acctbal")
    return _t(spark, d, "customer").select("c_custkey", (A.number_round(x) + 0.0).alias("r0"), (A.number_round(x, -2) + 0.0).alias("r2"), F.abs(x).alias("a"), F.greatest(x, F.col("c_nationkey").cast("double"), F.lit(7.0)).alias("hi"), F.least(x, F.col("c_nationkey").cast("double")).alias("lo"))


@query("""SELECT p_partkey, length(p_name)::BIGINT AS n, strlen(p_name)::BIGINT AS bytes, substr(p_name, 3, 4) AS mid, right(p_name, 3) AS tail,
CASE WHEN length(p_name) <= 9 THEN p_name ELSE substr(p_name, 1, 6) || '...' END AS cut, coalesce(nullif(regexp_extract(p_brand, '#(\\d+)', 1), ''), '?') AS num FROM part""")
def string_functions(spark, d):
    x = F.col("p_name")
    return _t(spark, d, "part").select(
        "p_partkey", F.char_length(x).cast("long").alias("n"), F.octet_length(x).cast("long").alias("bytes"), A.string_substring(x, 2, 4).alias("mid"), A.string_substring(x, -3).alias("tail"),
        A.string_truncate(x, 9).alias("cut"), A.string_slice_regexp(F.col("p_brand"), r"#(?<num>\d+)", "num", "?").alias("num"),
    )


@query("""SELECT vec_id, len(embedding)::BIGINT AS n, round(embedding[3]::DOUBLE, 6) AS third, len(embedding[2:4])::BIGINT AS part, len(embedding[-5:])::BIGINT AS tail,
round(list_filter(embedding, lambda x: x > 0.2)[1]::DOUBLE, 6) AS found FROM embeddings""")
def vector_functions(spark, d):
    v = F.col("embedding")
    six = lambda x: F.round(x.cast("double"), 6)
    return _t(spark, d, "embeddings").select("vec_id", F.size(v).cast("long").alias("n"), six(F.get(v, F.lit(2))).alias("third"), F.size(A.vector_slice(v, 1, 3)).cast("long").alias("part"), F.size(A.vector_slice(v, -5)).cast("long").alias("tail"), six(A.vector_find(v, F.lit(0.2).cast("float"), "GREATER")).alias("found"))


@query("SELECT p_partkey, coalesce(try_cast(replace(p_brand, 'Brand#', '') AS INT), -1) AS num, coalesce(try_cast(p_name AS INT), -7) AS bad FROM part")
def cast_loose(spark, d):
    return _t(spark, d, "part").select("p_partkey", A.cast_loose("Int32", F.replace("p_brand", F.lit("Brand#"), F.lit("")), -1).alias("num"), A.cast_loose("Int32", F.col("p_name"), -7).alias("bad"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark, d):
    return _t(spark, d, "events").select("event_id", A.json_extract(F.col("props"), "$.k").alias("k"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS h, length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS n FROM pages")
def html_untag(spark, d):
    x = X.html_untag(F.col("html"))
    return _t(spark, d, "pages").select("page_id", F.md5(x.cast("binary")).alias("h"), F.char_length(x).cast("long").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '(the|and)', '<span class=\"keyword\">\\1</span>', 'gi')) AS h FROM documents")
def highlight_html(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(A.highlight_html(F.col("text"), ["the", "and"]).cast("binary")).alias("h"))


_AROUND = "((?s:.{0,18}?)(?:[Tt][Hh][Ee]|[Aa][Nn][Dd])(?s:.{0,18}))"


@query(f"SELECT doc_id, list_transform(regexp_extract_all(text, '{_AROUND}')[1:3], lambda s: regexp_replace(ltrim(s), '(the|and)', '[[\\1]]', 'gi')) AS snippets FROM documents")
def snippet(spark, d):
    got = A.snippets(F.col("text"), ["the", "and"], width=40)
    return _t(spark, d, "documents").select("doc_id", got.alias("snippets"))


def _distance(name, f, sql):
    def run(spark, d):
        e = _t(spark, d, "embeddings")
        first = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
        return e.crossJoin(F.broadcast(first)).select("vec_id", (F.round(f(F.col("embedding"), F.col("q")), 5) + 0.0).alias("distance"))

    QUERIES[name] = run
    v = lambda c: f"list_transform({c}, lambda x: x::DOUBLE)"
    ORACLE_SQL[name] = f"WITH q AS (SELECT {v('embedding')} AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, {v('embedding')} AS v, q FROM embeddings, q) SELECT vec_id, round({sql}, 5) + 0.0 AS distance FROM e"


_distance("distance_cosine", A.distance_cosine, "1 - list_cosine_similarity(v, q)")
_distance("distance_inner_product", A.distance_inner_product, "1 - list_dot_product(v, q)")
_distance("distance_l1_norm", A.distance_l1_norm, "list_sum(list_transform(list_zip(v, q), lambda x: abs(x[1] - x[2])))")
_distance("distance_l2_norm_squared", A.distance_l2_norm_squared, "pow(list_distance(v, q), 2)")


@query("""WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 3)
SELECT vec_id, round(1 - list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q), 5) AS distance FROM embeddings, q ORDER BY 1 - list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q), vec_id LIMIT 10""")
def knn_top_k(spark, d):
    e = _t(spark, d, "embeddings")
    to = e.where("vec_id = 3").first()["embedding"]
    return joins.nearest(e, "embedding", to, 10, "vec_id").select("vec_id", F.round("distance", 5).alias("distance"))


# ---- lookups and semi-joins ---------------------------------------------------------------------------
@query("SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def ref_lookup(spark, d):
    return joins.reference(_t(spark, d, "customer"), _t(spark, d, "nation"), "c_nationkey", "n_nationkey").select("c_custkey", "n_name", "n_regionkey")


@query("SELECT c_custkey, count(o_orderkey) AS _nsubrecs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def index_source_records(spark, d):
    return joins.source_records(_t(spark, d, "customer"), "c_custkey", _t(spark, d, "orders"), "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def sub_filter_semi(spark, d):
    return joins.sub_filter(_t(spark, d, "orders"), "o_custkey", _t(spark, d, "customer"), "c_custkey", 'c_mktsegment == "BUILDING" && c_acctbal > 0').select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_sub_filter(spark, d):
    return joins.sub_filter(_t(spark, d, "orders"), "o_custkey", _t(spark, d, "customer"), "c_custkey", 'c_mktsegment == "BUILDING"', anti=True).select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND s_acctbal > n_regionkey * 1000)")
def in_records_equal(spark, d):
    bounds = _t(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") * 1000).alias("least"))
    return joins.in_records(_t(spark, d, "supplier"), bounds, (F.col("s_nationkey"), "EQUAL", "n_nationkey"), (F.col("s_acctbal"), "GREATER", "least")).select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM region WHERE p_size < r_regionkey * 5 AND p_retailprice > 900 + r_regionkey)")
def in_records_theta(spark, d):
    c = _t(spark, d, "region").select((F.col("r_regionkey") * 5).alias("size"), (F.col("r_regionkey") + 900).alias("price"))
    return joins.in_records(_t(spark, d, "part"), c, (F.col("p_size"), "LESS", "size"), (F.col("p_retailprice"), "GREATER", "price")).select("p_partkey")


# ---- text -----------------------------------------------------------------------------------------
@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the on')")
def match_scan(spark, d):
    return select(_t(spark, d, "documents"), filter='text @ "The on"').records.select("doc_id")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(f"SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0")
def match_phrase(spark, d):
    return _t(spark, d, "documents").where(X.phrase(F.col("text"), ["of", "the"])).select("doc_id")


@query(f"""SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS w FROM documents),
LATERAL (SELECT list_filter(range(1, len(w) + 1), lambda i: w[i] = 'that') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'for') AS b)
WHERE len(list_filter(a, lambda i: len(list_filter(b, lambda j: greatest(i, j) - least(i, j) - 1 <= 2)) > 0)) > 0""")
def match_near(spark, d):
    return select(_t(spark, d, "documents"), filter='text *N2 "that for"').records.select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])thr')")
def match_prefix(spark, d):
    return select(_t(spark, d, "documents"), query="thr*", match_columns="text").records.select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[Tt]h(e|at) [a-f]n')")
def match_regexp(spark, d):
    return select(_t(spark, d, "documents"), filter='text @~ "[Tt]h(e|at) [a-f]n"').records.select("doc_id")


@query(f"SELECT doc_id, {_TF.format('the')}::DOUBLE AS _score FROM documents WHERE contains(lower(text), 'the')")
def score_tf(spark, d):
    return select(_t(spark, d, "documents"), filter='text @ "the"', output_columns="doc_id, _score").records


@query(f"SELECT doc_id, least({_TF.format('the')}::DOUBLE, 2.0) AS _score FROM documents WHERE contains(lower(text), 'the')")
def score_tf_at_most(spark, d):
    got = select(_t(spark, d, "documents"), filter='text @ "the"').records
    from .operators.expression import Compiler
    from .plans import syntax as S

    return got.select("doc_id", Compiler(got).score(S.parse_script('scorer_tf_at_most(text, "the", 2)')).alias("_score"))


@query(f"""WITH w AS (SELECT doc_id, len(list_filter({_WORDS}, lambda x: x = 'the')) AS tf FROM documents), n AS (SELECT count(*) FILTER (tf > 0) AS df, count(*) AS n FROM w)
SELECT doc_id AS key, round(greatest(tf * ln(n.n::DOUBLE / df), 1.0), 6) AS _score FROM w, n WHERE tf > 0""")
def score_tf_idf(spark, d):
    docs = _t(spark, d, "documents")
    return _rounded(index.tf_idf(index.frequencies(docs, "doc_id", "text", only=["the"]), "the", docs.count()), _score=6)


@query(f"SELECT token, count(*) AS df, round(count(*) / (SELECT count(*) FROM documents), 8) AS ratio FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS token FROM documents) GROUP BY 1")
def index_df_ratio(spark, d):
    return _rounded(index.token_ratios(_t(spark, d, "documents"), "doc_id", "text"), ratio=8)


@query(f"""WITH t AS (SELECT conv_id * 1000 + turn AS key, {_WORDS} AS w FROM conversations), p AS (SELECT key, token, len(w) AS size, count(*) AS tf FROM (SELECT key, w, unnest(w) AS token FROM t) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM t)
SELECT key, token, round(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean)), 4) AS weight FROM p JOIN f USING (token), n""")
def vector_bm25(spark, d):
    t = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    return _rounded(index.bm25(t, "key", "text"), weight=4)


@query(f"WITH p AS (SELECT doc_id, len(list_filter({_WORDS}, lambda x: x = 'the')) AS a, len(list_filter({_WORDS}, lambda x: x = 'that')) AS b FROM documents) SELECT doc_id AS key, (a + b)::BIGINT AS _score FROM p WHERE a > 0 AND b > 0")
def search_postings(spark, d):
    p = index.frequencies(_t(spark, d, "documents"), "doc_id", "text", only=["the", "that"])
    return index.search(p, ["the", "that"]).select("key", F.col("_score").cast("long").alias("_score"))


@query(f"SELECT doc_id, list_unique(list_filter({_WORDS}, lambda x: x IN ('the', 'that', 'ones', 'and')))::DOUBLE AS _score FROM documents WHERE list_unique(list_filter({_WORDS}, lambda x: x IN ('the', 'that', 'ones', 'and'))) >= 3")
def similar(spark, d):
    return select(_t(spark, d, "documents"), filter='text *S3 "the that ones and"', output_columns="doc_id, _score").records


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the that') OR ((SELECT count(*) FROM documents WHERE contains(lower(text), 'the that')) <= 5000 AND contains(lower(text), 'that'))")
def match_escalate(spark, d):
    return escalate(_t(spark, d, "documents"), ['text @ "the that"', 'text @ "that"'], [5000]).select("doc_id")


@query("SELECT p_partkey FROM part WHERE levenshtein(split_part(p_name, ' ', 1), 'bleu') <= 1 OR levenshtein(split_part(p_name, ' ', 1), 'lbeu') + 1 <= 1 OR levenshtein(split_part(p_name, ' ', 1), 'belu') + 1 <= 1 OR levenshtein(split_part(p_name, ' ', 1), 'blue') + 1 <= 1")
def fuzzy_search(spark, d):
    p = _t(spark, d, "part").withColumn("colour", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return select(p, filter='fuzzy_search(colour, "bleu")').records.select("p_partkey")


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'zwischen')) AND NOT contains(lower(text), 'and') AND lang = 'en'")
def query_syntax(spark, d):
    return select(_t(spark, d, "documents"), query="(the OR zwischen) -and lang:en", match_columns="text").records.select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'les') OR contains(lower(text), 'los')")
def query_expansion(spark, d):
    more = {"article": ["the", "les", "los"]}
    return select(_t(spark, d, "documents"), query="article", match_columns="text", query_expander=more.get).records.select("doc_id")


@query(f"SELECT doc_id, 2 * {_TF.format('the')}::DOUBLE + (lang = 'en')::INT * 0 AS _score FROM documents WHERE contains(lower(text), 'the')")
def query_weights(spark, d):
    return select(_t(spark, d, "documents"), query="the", match_columns="text * 2", output_columns="doc_id, _score").records


@query(f"SELECT item_id, len(w)::BIGINT AS n, array_to_string(w[1:5], '|') AS head FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)")
def tokenize_words(spark, d):
    w = X.tokenize(F.col("text"))
    return _t(spark, d, "benchmark").select("item_id", F.size(w).cast("long").alias("n"), F.array_join(F.slice(w, 1, 5), "|").alias("head"))


@query("SELECT p_partkey, array_to_string([substr(lower(p_name), i, 3) for i in range(1, greatest(length(p_name) - 1, 2))], '|') AS grams FROM part")
def tokenize_ngrams(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(X.tokenize(F.col("p_name"), "TokenNgram", n=3), "|").alias("grams"))


@query("""WITH p AS (SELECT event_type AS item, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) SELECT item, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2""")
def suggest_pairs(spark, d):
    return index.learn_pairs(_t(spark, d, "events"), "user_id", "event_id", "event_type")


@query("SELECT p_name AS item, count(*) AS n FROM part WHERE starts_with(lower(p_name), 're') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def suggest_complete(spark, d):
    return index.complete(_t(spark, d, "part"), "p_name", "re")


@query("SELECT p_name AS item, count(*) AS n, levenshtein(lower(p_name), 'red wodget')::BIGINT AS distance FROM part WHERE levenshtein(lower(p_name), 'red wodget') BETWEEN 1 AND 2 GROUP BY 1, 3 ORDER BY 3, n DESC, 1 LIMIT 10")
def suggest_correct(spark, d):
    return index.correct(_t(spark, d, "part"), "p_name", "red wodget").withColumn("distance", F.col("distance").cast("long"))


# ---- logical tables, sources, streams, geography ---------------------------------------------------------
def _events(spark, d):
    return _t(spark, d, "events").withColumn("shard", F.date_format("ts", "yyyyMMdd"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09 12:00:00' AND event_type = 'click' ORDER BY ts, event_id LIMIT 50 OFFSET 5")
def logical_range_filter(spark, d):
    got = logical.range_filter(_events(spark, d), "ts", "2024-01-05", "2024-01-09T12:00:00", 'event_type == "click"', offset=5, limit=50, key="event_id", most_border="exclude")
    return got.select("event_id", _s("ts").alias("t"))


@query("SELECT count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND value > 20")
def logical_count(spark, d):
    return logical.count(_events(spark, d), "ts", "2024-01-05", "2024-01-20", "value > 20", least_border="exclude")


@query("SELECT event_type, count(*) AS _nsubrecs, round(avg(value), 5) AS _mean FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def logical_select_facet(spark, d):
    got = logical.select(_events(spark, d), "ts", "2024-01-10", drilldowns={"e": {"keys": "event_type", "calc_types": "MEAN", "calc_target": "value"}})
    return _rounded(got.drilldowns["e"], _mean=5)


@query("SELECT DISTINCT strftime(ts, '%Y%m%d') AS shard FROM events")
def logical_shard_list(spark, d):
    return logical.shard_list(_events(spark, d))


@query("SELECT event_id FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-28')")
def logical_table_remove(spark, d):
    return logical.remove(_events(spark, d), "ts", "2024-01-03", "2024-01-28").select("event_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000000, 1.5 FROM customer WHERE c_custkey < 10")
def load_upsert(spark, d):
    old = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = old.where("c_custkey % 3 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal"), F.lit(1).alias("_at"))
    new = new.unionByName(old.where("c_custkey < 10").select((F.col("c_custkey") + 1000000000).alias("c_custkey"), F.lit(1.5).alias("c_acctbal"), F.lit(2).alias("_at")))
    return io.upsert(old, new, "c_custkey", "_at")


@query("SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def column_copy(spark, d):
    return io.column_copy(_t(spark, d, "supplier"), _t(spark, d, "nation"), "s_nationkey", "n_nationkey", "n_name", "nation").select("s_suppkey", "nation")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0)")
def delete_records(spark, d):
    return io.delete(_t(spark, d, "customer"), "c_acctbal < 0").select("c_custkey")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return streams.tumbling(_t(spark, d, "events"), "ts", "1 hour", ["event_type"]).withColumn("start", _s("start"))


def _points(spark, d):
    k = F.col("c_custkey")
    p = geo.point((k * 7919) % 324000000 - 162000000, (k * 104729) % 648000000 - 324000000)
    return _t(spark, d, "customer").select("c_custkey", p.alias("place"))


_POINTS = "(SELECT c_custkey, (c_custkey * 7919) % 324000000 - 162000000 AS lat, (c_custkey * 104729) % 648000000 - 324000000 AS lon FROM customer)"
_RAD = "radians(({0}) / 3600000.0)"


@query(f"SELECT c_custkey, round(sqrt(pow({_RAD.format('lon + 300000000')} * cos({_RAD.format('(lat - 160000000) / 2.0')}), 2) + pow({_RAD.format('lat + 160000000')}, 2)) * 6357303, 3) AS metres FROM {_POINTS}")
def geo_distance(spark, d):
    return _points(spark, d).select("c_custkey", F.round(geo.distance(F.col("place"), geo.at("-160000000x-300000000")), 3).alias("metres"))


@query(f"SELECT c_custkey FROM {_POINTS} WHERE sqrt(pow({_RAD.format('lon + 300000000')} * cos({_RAD.format('(lat - 160000000) / 2.0')}), 2) + pow({_RAD.format('lat + 160000000')}, 2)) * 6357303 <= 500000")
def geo_in_circle(spark, d):
    return _points(spark, d).where(geo.in_circle(F.col("place"), geo.at("-160000000x-300000000"), 500000)).select("c_custkey")


@query(f"SELECT c_custkey FROM {_POINTS} WHERE lat BETWEEN -161000000 AND -155000000 AND lon BETWEEN -320000000 AND -250000000")
def geo_in_rectangle(spark, d):
    return _points(spark, d).where(geo.in_rectangle(F.col("place"), geo.at("-155000000x-320000000"), geo.at("-161000000x-250000000"))).select("c_custkey")


from . import catalog_tables  # noqa: E402, F401  (registers more queries)
