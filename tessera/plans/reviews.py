"""Queries of distributions, descriptions and chunking that the other modules leave out, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import core as co
from tessera.operators import chunking as ch
from tessera.operators import documents as do
from tessera.operators import operations as op
from tessera.operators import profiling as pr
from tessera.operators import retrieval as re_
from tessera.plans.common import VIEWS, Catalog, read, view
from tessera.sources import tables as ta

C = Catalog()


def counted(label: str, table: str, top: int | None = None) -> str:
    limit = f" LIMIT {top}" if top else ""
    return f'SELECT {label}, count(*) AS "count" FROM {table} WHERE {label} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1{limit}'


# what is most frequent
C.over("f07_top_vendors", "spend", lambda d: co.value_counts(d, "vendor", 10), counted("vendor", "v", 10))
C.over("f16_top_categories", "budget", lambda d: co.value_counts(d, "category", 5), counted("category", "v", 5))
C.over("o13_top_products", "stock", lambda d: co.value_counts(d, "product_name", 10), counted("product_name", "v", 10))

# distributions of several columns at once
MILESTONES = f"WITH v AS (SELECT *, 'owner' || (project_id % 7) AS owner FROM ({VIEWS['milestones'].replace('{', '').replace('}', '')}))"
C.free(
    "o26_milestone_distributions",
    lambda s, d: op.distributions(view(s, d, "milestones").withColumn("owner", F.concat(F.lit("owner"), (F.col("project_id") % 7).cast("string"))), ["status", "owner"]),
    f"{MILESTONES} SELECT 'status' AS dimension, status AS label, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'owner', owner, count(*) FROM v GROUP BY 2",
)
CANDIDATES = "WITH v AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'Hired' WHEN 'O' THEN 'Rejected' ELSE 'Interview' END AS stage, o_orderpriority AS position, 'source' || (o_custkey % 5) AS source FROM orders)"
C.on(
    "h11_candidates",
    "orders",
    lambda d: op.distributions(
        d.select(
            F.when(F.col("o_orderstatus") == "F", "Hired").when(F.col("o_orderstatus") == "O", "Rejected").otherwise("Interview").alias("stage"),
            F.col("o_orderpriority").alias("position"), F.concat(F.lit("source"), (F.col("o_custkey") % 5).cast("string")).alias("source"),
        ), ["stage", "position", "source"],
    ),
    f"{CANDIDATES} SELECT 'stage' AS dimension, stage AS label, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'position', position, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM v GROUP BY 2",
)
C.over(
    "o09_resolution_means", "incidents", lambda d: pr.grouped_mean(d, "time_to_resolve", ["severity", "category"]),
    """SELECT 'severity' AS dimension, severity AS label, round(avg(time_to_resolve), 4) AS mean, count(time_to_resolve) AS n FROM v GROUP BY 2
    UNION ALL SELECT 'category', category, round(avg(time_to_resolve), 4), count(time_to_resolve) FROM v GROUP BY 2""",
)

# surveys and values
FEEDBACK = "CASE event_type WHEN 'error' THEN 'negative' WHEN 'signup' THEN 'dissatisfied' WHEN 'view' THEN 'neutral' ELSE 'positive' END"
C.on(
    "a21_negative_feedback", "events", lambda d: pr.negative_feedback(d.select(F.expr(FEEDBACK).alias("sentiment")), "sentiment"),
    f"SELECT count(*) FILTER (WHERE s IN ('negative', 'dissatisfied')) AS negative, round(count(*) FILTER (WHERE s IN ('negative', 'dissatisfied')) * 100.0 / count(*), 4) AS negative_pct FROM (SELECT {FEEDBACK} AS s FROM events)",
)
C.on(
    "a17_rating_distribution", "events", lambda d: pr.rating_distribution(d.select((F.col("event_id") * 7 % 11).alias("rating")), "rating"),
    """WITH s AS (SELECT event_id * 7 % 11 AS rating FROM events)
    SELECT rating, count(*) AS n, (SELECT round(avg(rating), 4) FROM s) AS mean, (SELECT round(median(rating), 4) FROM s) AS median FROM s GROUP BY 1""",
)
C.on(
    "a16_value_distribution", "events", lambda d: pr.value_distribution(d.select("user_id", F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("value")), "value"),
    """WITH s AS (SELECT user_id, CASE WHEN event_id % 9 > 0 THEN value END AS value FROM events)
    SELECT round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS least, round(max(value), 4) AS most,
    count(*) - count(value) AS nulls, round((count(*) - count(value)) * 100.0 / (count(*) * 2), 4) AS null_pct FROM s""",
)
C.on(
    "a08_feature_statistics", "lineitem", lambda d: pr.feature_statistics(d.select("l_quantity", "l_discount", F.when(F.col("l_linenumber") < 6, F.col("l_tax")).alias("tax")), ["l_quantity", "l_discount", "tax"]),
    "WITH s AS (SELECT l_quantity, l_discount, CASE WHEN l_linenumber < 6 THEN l_tax END AS tax FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_pct, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(skewness({c}), 4) AS skew FROM s"""
        for c in ("l_quantity", "l_discount", "tax")
    ),
)

# descriptions of tables
NUMERIC, TEXT = ("c_acctbal", "c_nationkey"), ("c_mktsegment", "c_name")
C.on(
    "p32_describe", "customer", lambda d: pr.describe(d.select(*NUMERIC, *TEXT)),
    " UNION ALL ".join(
        [f"""SELECT '{c}' AS column_name, count({c}) AS count, NULL::BIGINT AS unique_values, NULL::VARCHAR AS top, NULL::BIGINT AS freq, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min,
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c})::DOUBLE, 4) AS max FROM customer""" for c in NUMERIC]
        + [f"""SELECT '{c}', count({c}), count(DISTINCT {c}), (SELECT {c} FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), (SELECT count(*) FROM customer GROUP BY {c} ORDER BY 1 DESC LIMIT 1),
        NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer""" for c in TEXT]
    ),
)
TYPES = "CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(data_type) END"
C.free(
    "q03_columns", lambda s, d: ta.table_columns({t: read(s, d, t) for t in ("nation", "region", "labels", "part")}),
    f"""SELECT table_name, ordinal_position::INT AS position, column_name, {TYPES} AS type, CASE table_name WHEN 'nation' THEN (SELECT count(*) FROM nation) WHEN 'region' THEN (SELECT count(*) FROM region)
    WHEN 'labels' THEN (SELECT count(*) FROM labels) ELSE (SELECT count(*) FROM part) END AS row_count FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'labels', 'part')""",
)
C.on("q03_preview", "nation", lambda d: ta.preview(d, ["n_nationkey"], 5), "SELECT * FROM nation ORDER BY n_nationkey LIMIT 5")
C.on("q06_by_category", "documents", lambda d: ta.list_documents(d.select("doc_id", F.col("lang").alias("category")), "en"), "SELECT doc_id, lang AS category FROM documents WHERE lang = 'en'")
C.on(
    "a26_record_profile", "events", lambda d: pr.record_profile(ta.parse_text_rows(d, "props", "k INT, other STRING").select("record.*")),
    """SELECT 'k' AS column_name, 'int' AS type, count(*) AS records, count(*) - count((props->>'k')::INT) AS nulls FROM events
    UNION ALL SELECT 'other', 'string', count(*), count(*) - count(props->>'other') FROM events""",
)
C.over(
    "s14_report", "stock", lambda d: pr.report_rows({"stock": op.stock(d).select("value", "units", "low_stock")}, {"low_stock": 0}),
    """, o AS (SELECT round(sum(value), 2) AS value, sum(qty_on_hand) AS units, count(*) FILTER (WHERE qty_on_hand <= reorder_point) AS low FROM v)
    SELECT 'stock' AS section, 'value' AS key, value::DOUBLE AS value, 'info' AS severity FROM o UNION ALL SELECT 'stock', 'units', units::DOUBLE, 'info' FROM o
    UNION ALL SELECT 'stock', 'low_stock', low::DOUBLE, CASE WHEN low > 0 THEN 'warning' ELSE 'info' END FROM o""",
)

# mail, transcripts, decks, languages
MOOD = "CASE length(body) % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END"
C.over(
    "x02_mail_leaders", "mails", lambda d: do.mail_leaders(d.withColumn("sentiment", F.expr(MOOD)), "sender", "recipient", "sentiment"),
    f"""SELECT * FROM (SELECT 'sender' AS kind, sender AS label, count(*) AS n FROM v GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'recipient', recipient, count(*) FROM v GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
    UNION ALL SELECT 'sentiment', {MOOD}, count(*) FROM v GROUP BY 2""",
)
C.on(
    "x05_transcript_content", "conversations", lambda d: do.transcript_content(d.withColumn("minutes", F.length("text") / 100.0), "text", "minutes"),
    """SELECT round(avg(length(text)), 4) AS mean_length, sum(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END)::BIGINT AS words,
    round(avg(length(text) / 100.0), 4) AS mean_minutes, round(max(length(text) / 100.0), 4) AS longest, round(min(length(text) / 100.0), 4) AS shortest FROM conversations""",
)
C.on("x05_topics", "conversations", lambda d: co.value_counts(d.select(F.concat(F.lit("topic"), (F.col("conv_id") % 4).cast("string")).alias("topic")), "topic"), "SELECT 'topic' || (conv_id % 4) AS topic, count(*) AS \"count\" FROM conversations GROUP BY 1")
C.over(
    "x09_decks", "files", lambda d: do.deck_statistics(d.withColumn("notes", F.when(F.col("pdf_id") % 3 == 0, F.col("filename"))), "page_count", "text_content", "notes"),
    """SELECT count(*) AS decks, sum(page_count)::BIGINT AS slides, round(avg(page_count), 4) AS mean_slides, round(avg(length(text_content)) / avg(page_count), 4) AS text_per_slide,
    count(*) FILTER (WHERE pdf_id % 3 = 0 AND filename IS NOT NULL) AS with_notes, sum(length(text_content))::BIGINT AS chars, round(avg(length(text_content)), 4) AS density FROM v""",
)
SCRIPT = r"""CASE WHEN regexp_matches(text, '[\x{1200}-\x{137F}]') THEN 'Amharic' WHEN regexp_matches(text, '[\x{0400}-\x{04FF}]') THEN 'Russian' WHEN regexp_matches(text, '[\x{0600}-\x{06FF}]') THEN 'Arabic'
 WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'Chinese' WHEN regexp_matches(text, '[\x{0900}-\x{097F}]') THEN 'Hindi' ELSE 'English' END"""
C.on("x14_languages", "documents", lambda d: do.collection_languages(d).select(F.array_join("languages", ",").alias("languages")), f"SELECT string_agg(l, ',' ORDER BY l) AS languages FROM (SELECT DISTINCT {SCRIPT} AS l FROM documents WHERE text IS NOT NULL)")

# chunk ids, a start node from a query, a rerank
C.on("v17_chunk_ids", "conversations", lambda d: d.select(re_.chunk_id("conv_id", "turn", F.lit("talk"), "text").alias("chunk_id")), "SELECT conv_id || '_' || turn AS chunk_id FROM conversations")
C.free(
    "g03_mentioned_walk",
    lambda s, d: re_.mentioned_walk(
        re_.edges_from(read(s, d, "customer").join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), [("officer", "c_nationkey", "manages", "client", "c_custkey"), ("client", "c_custkey", "in", "segment", "c_mktsegment")]),
        read(s, d, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("What does Officer "), F.col("r_regionkey").cast("string"), F.lit(" manage?")).alias("query")), 2,
    ),
    """WITH g AS (SELECT DISTINCT 'officer:' || c_nationkey AS src, 'manages' AS rel, 'client:' || c_custkey AS dst FROM customer UNION ALL SELECT DISTINCT 'client:' || c_custkey, 'in', 'segment:' || c_mktsegment FROM customer),
    a AS (SELECT r_regionkey AS query_id, src, rel, dst, 1::INT AS depth FROM region JOIN g ON src = 'officer:' || r_regionkey)
    SELECT * FROM a UNION ALL SELECT a.query_id, g.src, g.rel, g.dst, 2 FROM a JOIN g ON g.src = a.dst""",
)

# chunks, told by the same fold over a text's parts
DIGEST = 'count(*) AS chunks, sum(length(c))::BIGINT AS chars, max(length(c))::BIGINT AS longest'


def folded(parts: str, glue: str, size: int = ch.SIZE) -> str:
    """A list of parts joined while they fit, as DuckDB folds it: the chunks so far are kept in one string."""
    return f"""string_split(list_reduce({parts}, lambda a, x: a || CASE WHEN length(string_split(a, chr(1))[-1]) + length(x) + length({glue}) <= {size} THEN {glue} ELSE chr(1) END || x), chr(1))"""


def cleaned(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: trim(x)), lambda x: x != '')"


SENTENCES = cleaned(r"string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2))")
LINES = cleaned("string_split(coalesce(text, ''), chr(10))")
BLOCKS = rf"""b AS (SELECT doc_id, i, trim(l) AS block FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE trim(l) != ''),
 x AS (SELECT *, regexp_matches(block, '^[\p{{Lu}}0-9]') AND length(block) BETWEEN 2 AND 81 AND len(string_split_regex(block, '\s+')) <= 12 AS h FROM b)"""
STRUCTURED = f"""{BLOCKS}, s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM x), p AS (SELECT doc_id, section, list(block ORDER BY i) FILTER (WHERE NOT h) AS parts FROM s GROUP BY 1, 2),
 c AS (SELECT doc_id, section, unnest({folded('parts', 'chr(10)')}) AS c FROM p WHERE len(parts) > 0)"""
WINDOWS = """d AS (SELECT doc_id, text, length(text) AS n, greatest(ceil((length(text) - 200) / 1400.0)::BIGINT - 1, 0) AS last FROM documents WHERE length(text) > 0),
 m AS (SELECT *, last > 0 AND n - last * 1400 < 80 AND n - (last - 1) * 1400 <= 3000 AS mg FROM d), y AS (SELECT *, unnest(range(0, CASE WHEN mg THEN last ELSE last + 1 END)) AS i FROM m),
 w AS (SELECT doc_id, i, substr(text, (i * 1400 + 1)::BIGINT, CASE WHEN mg AND i = last - 1 THEN n - i * 1400 ELSE 1600 END) AS c FROM y)"""
CHUNK_SQL = {
    "k03_sentence_chunks": f"SELECT doc_id, {DIGEST} FROM (SELECT doc_id, unnest({folded('parts', chr(39) + ' ' + chr(39))}) AS c FROM (SELECT doc_id, {SENTENCES} AS parts FROM documents) WHERE len(parts) > 0) GROUP BY 1",
    "k04_paragraph_chunks": f"SELECT doc_id, {DIGEST} FROM (SELECT doc_id, unnest({folded('parts', '(chr(10) || chr(10))')}) AS c FROM (SELECT doc_id, {LINES} AS parts FROM documents) WHERE len(parts) > 0) GROUP BY 1",
    "k02_structured_chunks": f"WITH {STRUCTURED} SELECT doc_id, {DIGEST} FROM c GROUP BY 1",
    "k05_table_chunks": f"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) != '') AS l FROM documents), g AS (SELECT doc_id, l, unnest(range(0, ceil((len(l) - 1) / 25.0)::BIGINT)) AS i FROM l WHERE len(l) > 1)
        SELECT doc_id, {DIGEST} FROM (SELECT doc_id, l[1] || chr(10) || array_to_string(l[i * 25 + 2 : i * 25 + 26], chr(10)) AS c FROM g) GROUP BY 1""",
    "k08_automatic": """WITH l AS (SELECT text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) != '') AS l FROM documents)
        SELECT CASE WHEN len(list_filter(l, lambda x: contains(x, '|'))) * 2 > len(l) THEN 'table' WHEN contains(text, chr(10) || chr(10)) THEN 'paragraph' ELSE 'structure' END AS strategy, count(*) AS "count" FROM l GROUP BY 1""",
    "k11_finalize": rf"""WITH {WINDOWS}, t AS (SELECT doc_id, i, trim(regexp_replace(c, '\s+', ' ', 'g')) AS c FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sha256(lower(c)) ORDER BY i) AS seen FROM t)
        SELECT doc_id, count(*) FILTER (WHERE c != '' AND length(c) <= 3000 AND seen = 1) AS kept, count(*) FILTER (WHERE c = '' OR length(c) > 3000 OR seen > 1) AS rejected, sum(greatest(len(string_split_regex(c, '\s+')), 1))::BIGINT AS tokens FROM r GROUP BY 1""",
    "k13_hierarchy": f"""WITH {BLOCKS}, y AS (SELECT *, last_value(CASE WHEN h THEN block END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS heading FROM x),
        z AS (SELECT doc_id, heading, min(i) AS p, count(*) AS blocks FROM y WHERE heading IS NOT NULL GROUP BY 1, 2) SELECT doc_id, heading, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS section_id, blocks FROM z""",
    "v10_sub_queries": r"""SELECT item_id, CASE WHEN len(p) > 0 THEN least(len(p), 5) ELSE 1 END::INT AS parts FROM (SELECT item_id, list_filter(list_transform(string_split_regex(text, '(?i)\s+and\s+|\s+or\s+|,|/'), lambda x: trim(x)), lambda x: length(x) > 8) AS p FROM benchmark)""",
    "v11_compressed": rf"""WITH s AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) AS p FROM documents)),
        r AS (SELECT doc_id, s, i, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_intersect(list_distinct(string_split_regex(lower(s), '[^\p{{L}}\p{{M}}\p{{N}}_]+')), ['the', 'of', 'and'])) DESC, i) AS k FROM s)
        SELECT doc_id, length(string_agg(s, ' ' ORDER BY k))::INT AS chars FROM r WHERE k <= 3 GROUP BY 1""",
}
C.on(
    "k07_structure_or_windows", "documents", lambda d: ch.structure_or_windows(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"), F.max(F.length("content")).cast("long").alias("longest")),
    f"WITH {STRUCTURED}, {WINDOWS} SELECT doc_id, {DIGEST} FROM (SELECT doc_id, c FROM c UNION ALL SELECT doc_id, c FROM w WHERE doc_id NOT IN (SELECT doc_id FROM c)) GROUP BY 1",
)
C.on(
    "k14_ingest", "documents", lambda d: ch.ingest(d, do.script_language("text"), do.document_type("text")["type"], "source").select("doc_id", "filename", "chunk_count", "language"),
    rf"""WITH {STRUCTURED}, {WINDOWS}, u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, i) AS i, c FROM (SELECT doc_id, section, row_number() OVER () AS i, c FROM c UNION ALL SELECT doc_id, -1, i, c FROM w WHERE doc_id NOT IN (SELECT doc_id FROM c))),
    t AS (SELECT doc_id, i, trim(regexp_replace(c, '\s+', ' ', 'g')) AS c FROM u), k AS (SELECT doc_id, count(DISTINCT lower(c)) AS n FROM t WHERE c != '' AND length(c) <= 3000 GROUP BY 1)
    SELECT doc_id, source AS filename, n AS chunk_count, {SCRIPT} AS language FROM k JOIN documents USING (doc_id)""",
)
