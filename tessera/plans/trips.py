"""Queries that write tables out, read them back and bring them up to date, and inputs on which rare branches fire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import core as co
from tessera.operators import chunking as ch
from tessera.operators import finance as fi
from tessera.operators import profiling as pr
from tessera.operators import retrieval as re_
from tessera.operators.memory import hashing_embedder
from tessera.plans.common import Catalog, read
from tessera.plans.reviews import DIGEST, LINES, folded
from tessera.sources import snapshots as sn
from tessera.sources import tables as ta
from tessera.sources.scratch import scratch
from tessera.streaming import jobs

C = Catalog()


def lines_of(s: SparkSession, rows: DataFrame) -> str:
    """A folder with the text lines of ``rows``."""
    path = scratch(s)
    rows.write.text(path)
    return path


def csv_scan(s: SparkSession, d: str) -> DataFrame:
    orders = read(s, d, "orders")
    bad = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(F.format_string("%.2f", "o_totalprice"))
    path = lines_of(s, orders.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", bad).alias("value")))
    rows, rejects = ta.read_csv_checked(s, path, "key long, status string, price double", header=False)
    good = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 1).alias("total"))
    return good.unionByName(rejects.agg(F.lit("rejected").alias("status"), F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("total")))


C.free("s01_csv_with_rejects", csv_scan, """
    SELECT o_orderstatus AS status, count(*) AS n, round(sum(round(o_totalprice, 2)), 1) AS total FROM orders WHERE o_orderkey % 10 != 0 GROUP BY 1
    UNION ALL SELECT 'rejected', count(*), 0.0::DOUBLE FROM orders WHERE o_orderkey % 10 = 0""")


def json_scan(s: SparkSession, d: str) -> DataFrame:
    talk = read(s, d, "conversations")
    whole = F.to_json(F.struct("conv_id", "turn", "role"))
    path = lines_of(s, talk.select(F.when(F.col("conv_id") % 7 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("value")))
    rows, rejects = ta.read_json_checked(s, path, "conv_id long, turn int, role string")
    good = rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("turn").cast("long").alias("turns"))
    return good.unionByName(rejects.agg(F.lit("rejected").alias("role"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("turns")))


C.free("s02_json_with_rejects", json_scan, """
    SELECT role, count(*) AS n, sum(turn)::BIGINT AS turns FROM conversations WHERE conv_id % 7 != 0 GROUP BY 1
    UNION ALL SELECT 'rejected', count(*), 0::BIGINT FROM conversations WHERE conv_id % 7 = 0""")


def flattened(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    nested = read(s, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("home")).alias("who"), F.array(F.col("c_nationkey"), F.col("c_custkey")).alias("keys"))
    nested.write.json(path)
    flat = ta.flatten(s.read.schema(nested.schema).json(path))
    return flat.select("c_custkey", F.col("`who.name`").alias("name"), F.col("`who.home.nation`").cast("long").alias("nation"), F.col("keys"))


C.free("s03_flatten", flattened, "SELECT c_custkey, c_name AS name, c_nationkey::BIGINT AS nation, '[' || c_nationkey || ',' || c_custkey || ']' AS keys FROM customer")


def listing(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    ranked = read(s, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.col("doc_id").cast("string").alias("value")).repartition(1)
    ranked.write.partitionBy("source").text(path)
    found = ta.list_files(s, path, "*.txt", most=1 << 30).withColumn("source", F.regexp_extract("path", r"source=([^/]+)/", 1))
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count("reject_reason").alias("rejected"), F.sum("length").alias("bytes"))


C.free("s07_listing", listing, "SELECT coalesce(source, 'none') AS source, 1::BIGINT AS files, 0::BIGINT AS rejected, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS bytes FROM documents GROUP BY 1")


def published(s: SparkSession, d: str) -> DataFrame:
    root, docs = scratch(s), read(s, d, "documents").select("doc_id", "n_chars")
    ta.publish(docs.where("doc_id % 2 = 0"), root, "1", "doc_id", model="m")
    ta.publish(docs, root, "2", "doc_id", model="m")
    return ta.consistency(s, root, "doc_id")


C.free("s10_publish", published, "SELECT count(*) AS manifest_count, count(*) AS table_count, count(DISTINCT doc_id) AS ids, count(*) = count(DISTINCT doc_id) AS consistent FROM documents")


def exported(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    ta.write_csv(read(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    back = ta.read_csv(s, path, "c_custkey long, c_name string, c_nationkey int")
    return back.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("c_name").alias("first"))


C.free("s12_csv_export", exported, "SELECT c_nationkey::INT AS c_nationkey, count(*) AS n, min(c_name) AS first FROM customer GROUP BY 1")


def logged(s: SparkSession, d: str) -> DataFrame:
    path, talk = scratch(s), read(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("code"), F.col("text").alias("args"))
    for part in (0, 1):
        ta.append_log(talk.where(F.col("conv_id") % 2 == part), path, {"args": 80, "code": 200}, {"code": "code_hash"})
    return s.read.parquet(path).select("conv_id", "turn", F.length("args").alias("args"), F.length("code").alias("code"), "code_hash")


C.free("s13_tool_log", logged, "SELECT conv_id, turn, least(length(text), 80)::INT AS args, least(length(text), 200)::INT AS code, sha256(text) AS code_hash FROM conversations")


def kept_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents in a snapshot, the toxic ones deleted in a second batch, and of the rest those that are asked for."""
    root, docs = scratch(s), read(s, d, "documents").select("doc_id", "lang", "n_chars")
    gone = read(s, d, "labels").where("toxic = 1").select("doc_id")
    sn.upsert_batch(s, root, docs, ["doc_id"], "n_chars", 0, buckets=8)
    sn.delete_batch(s, root, gone, 1)
    return ta.where_equal(sn.read_snapshot(s, root), {"lang": "EN"}, exact=False)


C.free("k15_delete_and_get", kept_documents, "SELECT doc_id, lang, n_chars FROM documents WHERE lower(lang) = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")


def bucketed(s: SparkSession, d: str) -> DataFrame:
    root, rows = scratch(s), read(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    last = rows.groupBy("user_id", F.pmod("event_id", F.lit(3)).cast("int").alias("batch")).agg(F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id")).alias("x")).select("user_id", "batch", "x.*")
    for n in (0, 1, 2, 2):
        sn.upsert_batch(s, root, last.where(F.col("batch") == n).drop("batch"), ["user_id"], "ts", n, buckets=16)
    return sn.read_snapshot(s, root).select("user_id", "ts", "event_type")


C.free("t04_bucketed_upsert", bucketed, "SELECT user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 3 DESC, event_id DESC) = 1")
C.on("t06_running_state", "events", lambda d: jobs.running_state_of(d, idle="2 days").select("entity", "events", "last", F.array_join("recent", ",").alias("recent")), """
    WITH g AS (SELECT user_id, ts, event_type, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 DAY AS gap FROM events),
    f AS (SELECT user_id, max(ts) FILTER (WHERE gap) AS since FROM g GROUP BY 1),
    l AS (
      SELECT e.user_id, ts, event_type, row_number() OVER (PARTITION BY e.user_id ORDER BY ts DESC, event_type DESC) AS i
      FROM events e JOIN f USING (user_id) WHERE since IS NULL OR ts >= since)
    SELECT user_id AS entity, count(*) AS events, max(event_type) FILTER (WHERE i = 1) AS last,
           string_agg(event_type, ',' ORDER BY i DESC) FILTER (WHERE i <= 10) AS recent
    FROM l GROUP BY 1""")



def embedded(s: SparkSession, d: str) -> DataFrame:
    """Texts embedded in three batches, of which one comes twice and one is known already in part."""
    root, talk = scratch(s), read(s, d, "conversations")
    for n, rows in ((0, talk.where("turn = 0")), (1, talk), (1, talk), (2, talk.where("turn = 1"))):
        jobs.embed_batch(rows, root, hashing_embedder(), "m", n)
    return sn.read_snapshot(s, root).agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("cache_key").alias("texts"), F.count_if(F.size("vector") == 64).alias("vectors"), F.max("tries").alias("tries"))


C.free("t05_resumed_embedding", embedded, "SELECT count(DISTINCT text) AS keys, count(DISTINCT text) AS texts, count(DISTINCT text) AS vectors, 1::INT AS tries FROM conversations")

# columns as they come: numbers and times in text, names by role, empty rows and columns
C.on("p05_coerce_numeric", "orders", lambda d: co.coerce_numeric(d.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.format_string("%.2f", "o_totalprice")).alias("price"), F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("share"), "o_orderstatus"), ["price", "share", "o_orderstatus"]), """
    SELECT o_orderkey, CASE WHEN o_orderkey % 9 != 0 THEN round(o_totalprice, 2) END AS price, o_custkey::DOUBLE AS share, NULL::DOUBLE AS o_orderstatus FROM orders""")
C.on("p06_coerce_timestamp", "orders", lambda d: d.select("o_orderkey", co.coerce_timestamp(F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))).alias("at")), """
    SELECT o_orderkey, CASE WHEN o_orderkey % 9 != 0 THEN date_trunc('second', o_orderdate::TIMESTAMP) END AS at FROM orders""")
ROLES = {"amount": ["total", "O Total-Price"], "client": ["o_custkey"], "region": ["area"]}


def by_role(d: DataFrame) -> DataFrame:
    found = co.resolve_columns(d.schema, ROLES)
    return d.groupBy(F.col(found["client"]).alias("client")).agg(F.round(F.sum(found["amount"]), 2).alias("amount"), F.lit(found["region"] is None).alias("no_region"))


C.on("p11_resolve_columns", "orders", by_role, "SELECT o_custkey AS client, round(sum(o_totalprice), 2) AS amount, true AS no_region FROM orders GROUP BY 1")


def emptied(d: DataFrame) -> DataFrame:
    some = F.col("p_partkey") % 4 != 0
    return co.drop_empty(d.select(F.when(some, F.col("p_partkey")).alias(" key "), F.lit(None).cast("string").alias("nothing"), F.when(some, F.col("p_brand")).alias("brand")))


C.on("p12_drop_empty", "part", emptied, "SELECT p_partkey AS key, p_brand AS brand FROM part WHERE p_partkey % 4 != 0")

# SQL over a table, with the result's size, first rows and statistics
ASKED = "SELECT o_orderpriority AS priority, count(*) AS n, min(o_custkey) AS first FROM sql_data GROUP BY 1 ORDER BY 1"
C.free("q01_sql_report", lambda s, d: ta.sql_report(s, ASKED, {"sql_data": read(s, d, "orders")}, first=3), f"""
    WITH r AS ({ASKED.replace("sql_data", "orders")}),
    p AS (SELECT *, row_number() OVER (ORDER BY priority) AS i FROM r)
    SELECT 'rows' AS section, NULL::VARCHAR AS name, NULL::VARCHAR AS statistic, count(*)::DOUBLE AS value, NULL::VARCHAR AS text FROM r
    UNION ALL SELECT 'preview', i::VARCHAR, NULL, NULL, to_json({{'priority': priority, 'n': n, 'first': first}})::VARCHAR FROM p WHERE i <= 3
    """ + "".join(f"""
    UNION ALL SELECT 'statistics', '{c}', '{k}', {e}, NULL FROM r""" for c in ("n", "first") for k, e in (
        ("count", f"count({c})::DOUBLE"), ("mean", f"round(avg({c}), 4)"), ("std", f"round(stddev_samp({c}), 4)"), ("min", f"min({c})::DOUBLE"), ("max", f"max({c})::DOUBLE"),
        ("q25", f"round(quantile_cont({c}, 0.25), 4)"), ("q50", f"round(quantile_cont({c}, 0.5), 4)"), ("q75", f"round(quantile_cont({c}, 0.75), 4)")))
    + "".join(f"""
    UNION ALL SELECT 'statistics', 'priority', '{k}', {e}, {t} FROM r""" for k, e, t in (
        ("count", "count(priority)::DOUBLE", "NULL"), ("unique_values", "count(DISTINCT priority)::DOUBLE", "NULL"), ("freq", "max(1)::DOUBLE", "NULL"), ("top", "NULL", "min(priority)"))))

# inputs on which rules fire
C.on("p17_outliers_of_a_long_tail", "lineitem", lambda d: co.iqr_outliers(d.select("l_orderkey", "l_linenumber", F.pow("l_quantity", F.lit(6.0)).alias("v")), "v").select("l_orderkey", "l_linenumber", F.round("v").alias("v")), """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity ** 6 AS v FROM lineitem),
    q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x)
    SELECT l_orderkey, l_linenumber, round(v) AS v FROM x, q WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)""")
C.on("f29_anomalies_of_a_long_tail", "lineitem", lambda d: fi.payroll_anomalies(d.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("department"), F.pow("l_quantity", F.lit(6.0)).alias("salary")), department="department").select("l_orderkey", "l_linenumber", "department"), """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS department, l_quantity ** 6 AS v FROM lineitem),
    q AS (SELECT department, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x GROUP BY 1)
    SELECT l_orderkey, l_linenumber, department FROM x JOIN q USING (department) WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)""")
C.on("a11_pairs_above_a_low_bar", "lineitem", lambda d: pr.correlated_pairs(d.select((F.col("l_quantity") * 2 + F.col("l_linenumber")).alias("x"), "l_quantity", (-F.col("l_quantity") + F.col("l_tax")).alias("y"), "l_tax"), ["x", "l_quantity", "y", "l_tax"], 0.8), """
    WITH v AS (SELECT l_quantity * 2 + l_linenumber AS x, l_quantity AS q, -l_quantity + l_tax AS y FROM lineitem)
    SELECT 'x' AS a, 'l_quantity' AS b, round(corr(x, q), 4) AS r FROM v UNION ALL SELECT 'x', 'y', round(corr(x, y), 4) FROM v UNION ALL SELECT 'l_quantity', 'y', round(corr(q, y), 4) FROM v""")


def damaged(d: DataFrame) -> DataFrame:
    n, e = F.col("vec_id") % 10, F.col("embedding")
    return d.select("vec_id", F.when(n == 0, None).when(n == 1, F.slice(e, 1, 10)).when(n == 2, F.transform(e, lambda x: x * float("inf"))).otherwise(e).alias("embedding"))


C.on("v16_damaged_vectors", "embeddings", lambda d: re_.invalid_vectors(damaged(d), "embedding", 64).groupBy("reason").count(), """
    SELECT CASE vec_id % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'width' ELSE 'not finite' END AS reason, count(*) AS "count" FROM embeddings WHERE vec_id % 10 < 3 GROUP BY 1""")


def holed(d: DataFrame) -> DataFrame:
    return d.select(F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("p_size"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice")).alias("p_retailprice"))


C.on("a12_readiness_of_holes", "part", lambda d: pr.readiness(holed(d)), """
    WITH x AS (SELECT (count(*) FILTER (WHERE p_partkey % 3 = 0) + count(*) FILTER (WHERE p_partkey % 4 = 0)) / (2.0 * count(*)) AS s FROM part)
    SELECT round(s, 4) AS null_share, CASE WHEN s < 0.1 THEN 'READY' ELSE 'NEEDS_WORK' END AS verdict, false AS needs_encoding, s > 0 AS needs_imputing FROM x""")
C.on("k10_question_chunks", "documents", lambda d: ch.question_chunks(d.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"), F.max(F.length("content")).cast("long").alias("longest")),
     f"SELECT doc_id, {DIGEST} FROM (SELECT doc_id, unnest({folded('parts', '(chr(10) || chr(10))', 1000)}) AS c FROM (SELECT doc_id, {LINES} AS parts FROM documents) WHERE len(parts) > 0) GROUP BY 1")
