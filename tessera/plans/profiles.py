"""Queries of profiles, statistics, series, and the primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import core as co
from tessera.operators import operations as op
from tessera.operators import profiling as pr
from tessera.plans.business import cnt, pct
from tessera.plans.common import Catalog, read
from tessera.sources import tables as ta

C = Catalog()
LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
per_line = " UNION ALL ".join

C.on("p13_value_counts", "customer", lambda d: co.value_counts(d, "c_nationkey", 10), 'SELECT c_nationkey, count(*) AS "count" FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')
C.on("p17_iqr_outliers", "orders", lambda d: co.iqr_outliers(d.select("o_orderkey", "o_totalprice"), "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)")
C.on("p18_sigma_outliers", "customer", lambda d: co.sigma_outliers(d.select("c_custkey", "c_acctbal"), "c_acctbal", 1.5).select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) + 1.5 * stddev_samp(c_acctbal) FROM customer)")
C.on("p21_pct_rank", "part", lambda d: co.with_pct_ranks(d, {"pct": F.col("p_size")}, ["p_brand"]).select("p_partkey", co.r("pct", 6).alias("pct")), "SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 6) AS pct FROM part")
C.on("p04_parse_number", "orders", lambda d: d.select("o_orderkey", co.parse_number(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("n"), co.parse_number(F.lit("n/a")).alias("bad")), "SELECT o_orderkey, round(o_totalprice, 2) AS n, NULL::DOUBLE AS bad FROM orders")
C.on("p09_normalize_label", "orders", lambda d: d.select(co.normalize_label("o_orderpriority").alias("label")).groupBy("label").count(), """SELECT trim(regexp_replace(regexp_replace(lower(o_orderpriority), '[_-]', ' ', 'g'), '\\s+', ' ', 'g')) AS label, count(*) AS "count" FROM orders GROUP BY 1""")
C.on("p29_duplicate_keys", "lineitem", lambda d: d.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_keys")), "SELECT coalesce(sum(k), 0)::BIGINT AS duplicate_keys FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
C.on("p24_top_n_share", "lineitem", lambda d: co.top_n_share(d, "l_extendedprice", 10).select(co.r("share", 6).alias("share")), "SELECT round(sum(l_extendedprice) FILTER (WHERE i <= 10) * 100 / sum(l_extendedprice), 6) AS share FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC) AS i FROM lineitem)")

ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
C.on("a01_missing_profile", "orders", pr.missing_profile, per_line(f"SELECT '{c}' AS column_name, {cnt(c + ' IS NULL')} AS missing, {pct(cnt(c + ' IS NULL'), 'count(*)')} AS missing_pct FROM orders" for c in ORDERS))
C.on("a07_table_quality", "events", lambda d: pr.table_quality(d.select("user_id", "event_type", "value")), """SELECT count(*) AS row_count, 0::BIGINT AS missing_cells, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, value FROM events)))::BIGINT AS duplicate_rows, 0.0::DOUBLE AS missing_pct,
 round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, value FROM events))) * 100.0 / count(*), 4) AS duplicate_pct, (100 - CASE WHEN (count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, value FROM events))) * 100.0 / count(*) > 5 THEN 15 ELSE 0 END)::INT AS score,
 2::INT AS numeric_columns, 1::INT AS string_columns, 0::INT AS datetime_columns, CASE WHEN (count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, value FROM events))) * 100.0 / count(*) > 5 THEN 'EXCELLENT' ELSE 'EXCELLENT' END AS grade, true AS consistent_lengths, 'No missing cells.' AS recommendation FROM events""")
NUM = " UNION ALL ".join(f"""SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(skewness({c}), 4) AS skew, 0.0::DOUBLE AS missing_pct,
 (SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers FROM lineitem""" for c in LINE)
C.on("a04_numeric_profile", "lineitem", lambda d: pr.numeric_profile(d, LINE), NUM)
C.on("a05_string_profile", "orders", lambda d: pr.string_profile(d, ["o_orderstatus", "o_orderpriority"]), per_line(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct, {cnt(c + chr(61) + chr(39) * 2)} AS empty, (SELECT {c} FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common FROM orders".replace("AS distinct", 'AS "distinct"') for c in ("o_orderstatus", "o_orderpriority")))
C.on("a10_class_distribution", "embeddings", lambda d: pr.class_distribution(d, "label"), 'SELECT label::VARCHAR AS label, count(*) AS "count" FROM embeddings GROUP BY 1')
C.on("a11_correlated_pairs", "lineitem", lambda d: pr.correlated_pairs(d, LINE, 0.1), "SELECT * FROM (" + per_line(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM lineitem" for i, a in enumerate(LINE) for b in LINE[i + 1 :]) + ") WHERE abs(r) > 0.1")
C.on("a12_readiness", "part", pr.readiness, "SELECT 0.0::DOUBLE AS null_share, 'READY' AS verdict, true AS needs_encoding, false AS needs_imputing FROM part LIMIT 1")
KINDS = ("click", "error", "purchase", "signup", "view")
C.on(
    "a14_all_metrics", "lineitem", lambda d: pr.source_correlation(d.withColumn("metric", F.concat_ws("-", "l_returnflag", "l_linestatus")), "l_suppkey", "metric", "l_quantity"),
    """
    WITH m AS (SELECT l_suppkey AS s, concat_ws('-', l_returnflag, l_linestatus) AS m, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2)
    SELECT a.m AS a, b.m AS b, round(corr(a.x, b.x), 4) AS r, abs(corr(a.x, b.x)) > 0.7 AS strong
    FROM m a JOIN m b USING (s) WHERE a.m < b.m GROUP BY 1, 2""",
)
C.on("a14_source_correlation", "events", lambda d: pr.source_correlation(d, "user_id", "event_type", "value", KINDS), "WITH w AS (SELECT user_id, " + ", ".join(f"avg(value) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1) " + per_line(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r, abs(corr({a}, {b})) > 0.7 AS strong FROM w" for i, a in enumerate(KINDS) for b in KINDS[i + 1 :]))
C.on("a13_records_by_source", "events", lambda d: op.distributions(d, ["user_id", "event_type"]), "SELECT 'user_id' AS dimension, user_id::VARCHAR AS label, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY 2")
C.on("a15_coverage", "events", lambda d: pr.coverage(d, "ts").select("days", "coverage"), "SELECT d AS days, CASE WHEN d > 30 THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage FROM (SELECT floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0)::BIGINT AS d FROM events)")
RATED = "WITH s AS (SELECT (event_id % 11)::DOUBLE AS rating, event_type, user_id FROM events)"
rated = lambda d: d.select((F.col("event_id") % 11).cast("double").alias("rating"), "event_type", "user_id")
C.on("a18_nps", "events", lambda d: co.with_quantiles(rated(d).agg(co.r(pr.nps("rating")).alias("nps"), co.r(F.avg("rating")).alias("mean")), rated(d), {"median": ("rating", 0.5)}), f"{RATED} SELECT {pct(cnt('rating >= 9') + ' - ' + cnt('rating <= 6'), 'count(*)')} AS nps, round(avg(rating), 4) AS mean, round(median(rating), 4) AS median FROM s")
C.on("a19_satisfaction", "events", lambda d: pr.grouped_mean(rated(d), "rating", ["event_type", "user_id"]), f"{RATED} SELECT 'event_type' AS dimension, event_type AS label, round(avg(rating), 4) AS mean, count(rating) AS n FROM s GROUP BY 2 UNION ALL SELECT 'user_id', user_id::VARCHAR, round(avg(rating), 4), count(rating) FROM s GROUP BY 2")
C.on("a20_satisfaction_tiers", "events", lambda d: pr.satisfaction_tiers(rated(d), "rating"), f"{RATED} SELECT {cnt('rating >= 8')} AS satisfied, {cnt('rating >= 6 AND rating < 8')} AS neutral, {cnt('rating < 6')} AS dissatisfied FROM s")
daily = lambda d: d.groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
DAILY = "WITH s AS (SELECT date_trunc('day', o_orderdate) AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)"
C.on("a22_series", "orders", lambda d: pr.series_statistics(daily(d), "day", "value"), f"""{DAILY}, p AS (SELECT day, value, value / lag(value) OVER (ORDER BY day) - 1 AS p FROM s), x AS (SELECT (arg_max(value, day) - arg_min(value, day)) / floor((epoch_us(max(day)) - epoch_us(min(day))) / 86400000000.0) AS slope FROM s)
 SELECT count(value) AS points, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, round(median(value), 4) AS median, round(slope, 4) AS slope, CASE WHEN slope > 0 THEN 'UP' ELSE 'DOWN' END AS trend,
 round(stddev_samp(p), 4) AS volatility, round(stddev_samp(value) / (avg(value) + 1e-4), 4) AS variation, round(max(value) - min(value), 4) AS range, least(floor(count(value) / 4), 12)::BIGINT AS horizon, count(value) > 20 AS sufficient FROM p, x GROUP BY slope""")
C.on(
    "a28_one_series", "events", lambda d: pr.indicators(d.groupBy("ts").agg(F.sum("value").alias("value")), "ts", "value", size=5000).select("ts", "moving_average", "momentum", "rsi"),
    """
    WITH s AS (SELECT ts, sum(value) AS value FROM events GROUP BY ts),
    d AS (SELECT ts, value, value - lag(value) OVER (ORDER BY ts) AS step, lag(value, 20) OVER (ORDER BY ts) AS l FROM s),
    u AS (SELECT *, CASE WHEN step > 0 THEN step ELSE 0 END AS up, CASE WHEN step < 0 THEN -step ELSE 0 END AS down FROM d),
    a AS (
      SELECT ts, value, l, avg(value) OVER (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m,
             avg(up) OVER (ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS up,
             avg(down) OVER (ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS down
      FROM u)
    SELECT ts, round(m, 6) AS moving_average, round(value - l, 4) AS momentum,
           round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 4) AS rsi
    FROM a""",
)
C.on("a28_indicators", "events", lambda d: pr.indicators(d.select("event_id", "user_id", "ts", "value"), "ts", "value", ["user_id"]).select("event_id", "moving_average", "band_low", "band_high", "momentum"), """SELECT event_id, round(m, 6) AS moving_average, round(m - 2 * s, 6) AS band_low, round(m + 2 * s, 6) AS band_high, round(value - l, 4) AS momentum FROM (SELECT event_id, value, avg(value) OVER w AS m, coalesce(stddev_samp(value) OVER w, 0) AS s, lag(value, 20) OVER (PARTITION BY user_id ORDER BY ts) AS l
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")

C.free("s08_describe_tables", lambda s, d: ta.describe_tables({t: read(s, d, t) for t in ("customer", "orders", "part")}), per_line(f"SELECT '{t}' AS table_name, {n}::INT AS columns, count(*) AS row_count, 0::BIGINT AS missing, '{t} has ' || count(*) || ' rows and {n} columns' AS summary FROM {t}" for t, n in (("customer", 5), ("orders", 6), ("part", 6))))
C.free("q02_sql", lambda s, d: ta.run_sql(s, "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM sql_orders JOIN sql_customer ON o_custkey = c_custkey JOIN sql_nation ON c_nationkey = n_nationkey GROUP BY n_name", {f"sql_{t}": read(s, d, t) for t in ("orders", "customer", "nation")}),
       "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
C.on("q05_where_equal", "customer", lambda d: ta.where_equal(d, {"c_mktsegment": "building"}, exact=False).select("c_custkey"), "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
C.free("s09_upsert", lambda s, d: ta.upsert(read(s, d, "events").select("user_id", "ts", "event_id"), read(s, d, "events").where("event_type = 'error'").select("user_id", "ts", "event_id"), ["user_id"], "ts").select("user_id", "event_id"),
       "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
C.free("s11_drift", lambda s, d: ta.drift(read(s, d, "documents"), read(s, d, "labels"), "doc_id"), "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_first, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_second, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) > 2 AS drifted")
C.on("s04_parse_props", "events", lambda d: ta.parse_text_rows(d, "props", "k INT").select("event_id", F.col("record.k").alias("k")), "SELECT event_id, (props->>'k')::INT AS k FROM events")
