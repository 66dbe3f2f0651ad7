"""Queries of document collections, chunks, retrieval and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import chunking as ch
from tessera.operators import documents as do
from tessera.operators import memory as me
from tessera.operators import retrieval as re_
from tessera.operators import vectors as ve
from tessera.plans.business import cnt
from tessera.plans.common import Catalog, read
from tessera.plans.reviews import CHUNK_SQL
from tessera.streaming import jobs

C = Catalog()
WORDS = r"CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split_regex(regexp_replace(regexp_replace(text, '^ +', ''), ' +$', ''), '\s+')) END"

C.on("x04_transcript", "conversations", lambda d: do.transcript_summary(d, "role", "text", "conv_id"), f"SELECT role, count(*) AS turns, sum({WORDS})::BIGINT AS words, round(avg(length(text)), 4) AS mean_length, count(DISTINCT conv_id) AS transcripts, round(count(*) / (SELECT count(*) FROM conversations), 4) AS share FROM conversations GROUP BY role")
KINDS = tuple(do.ENTITIES)


def matches(kind: str) -> str:
    """The distinct matches of an entity's pattern in order, as one string; DuckDB keeps the first of equal ones."""
    found = f"regexp_extract_all(coalesce(text, ''), '{do.ENTITIES[kind].replace(chr(39), chr(39) * 2)}', 0)"
    return f"array_to_string(list_filter({found}, lambda x, i: list_position({found}, x) = i), '|') AS {kind}"


C.on("x11_entities", "documents", lambda d: do.extract_entities(d).select("doc_id", *[F.array_join(k, "|").alias(k) for k in KINDS]), f"SELECT doc_id, {', '.join(map(matches, KINDS))} FROM documents")
C.on("x03_urgent", "conversations", lambda d: d.groupBy("role").agg(F.count_if(F.col("text").rlike("(?i)urgent|important|asap")).alias("urgent")), "SELECT role, count(*) FILTER (WHERE regexp_matches(text, '(?i)urgent|important|asap')) AS urgent FROM conversations GROUP BY role")
C.on("x12_redact_mail", "documents", lambda d: d.select("doc_id", F.sha2(F.regexp_replace("text", do.EMAIL, "[EMAIL]"), 256).alias("h")), f"SELECT doc_id, sha256(regexp_replace(text, '{do.EMAIL}', '[EMAIL]', 'g')) AS h FROM documents")
C.on("x12_redact", "documents", lambda d: d.select("doc_id", F.sha2(do.redact("text"), 256).alias("h")))  # word ends beside accented letters differ in DuckDB
C.on("x13_script_language", "documents", lambda d: d.groupBy(do.script_language("text").alias("language")).count(), """SELECT CASE WHEN regexp_matches(text, '[\\x{1200}-\\x{137F}]') THEN 'Amharic' WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 'Russian' WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'Arabic' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'Chinese' WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'Hindi' ELSE 'English' END AS language, count(*) AS "count" FROM documents GROUP BY 1""")
KIND = "CASE " + " ".join("WHEN regexp_matches(lower(text), '" + "|".join(w) + f"') THEN '{n}'" for n, w, _ in do.TYPES) + " ELSE 'general' END"
C.on("x15_document_type", "documents", lambda d: d.groupBy(do.document_type("text")["type"].alias("type")).count(), f'SELECT {KIND} AS type, count(*) AS "count" FROM documents GROUP BY 1')
C.on("x16_collection", "documents", do.collection_summary, f"SELECT count(*) AS documents, sum(w)::BIGINT AS words, round(avg(w), 4) AS mean_words, max(w)::BIGINT AS most_words FROM (SELECT {WORDS} AS w FROM documents)")
C.free("x17_section_diff", lambda s, d: do.section_diff(read(s, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("id"), "text"), read(s, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("id"), "text"), "id").groupBy("id", "side").count(),
       """WITH x AS (SELECT DISTINCT conv_id AS id, role, trim(unnest(string_split(text, chr(10)))) AS s FROM conversations) SELECT id, side, count(*) AS "count" FROM (SELECT id, 'removed' AS side, s FROM x WHERE role = 'user' AND s != '' AND NOT EXISTS (SELECT 1 FROM x y WHERE y.id = x.id AND y.s = x.s AND y.role = 'assistant')
 UNION ALL SELECT id, 'added', s FROM x WHERE role = 'assistant' AND s != '' AND NOT EXISTS (SELECT 1 FROM x y WHERE y.id = x.id AND y.s = x.s AND y.role = 'user')) GROUP BY 1, 2""")  # fmt: skip


def next_turns(s, d):
    talk = read(s, d, "conversations")
    return talk.select("conv_id", "turn", F.col("text").alias("a")).join(talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])


C.free("x18_pair_similarity", lambda s, d: do.pair_similarity(next_turns(s, d)).select("conv_id", "turn", "ratio"))
C.on("x18_near_documents", "documents", do.near_documents)
C.free("x19_stack", lambda s, d: do.stack([read(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), read(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))]), "SELECT r_regionkey AS k, r_name AS name, NULL::INT AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
C.on("x20_goal_category", "conversations", lambda d: d.groupBy(do.goal_category("text").alias("category")).count(), """SELECT CASE WHEN regexp_matches(lower(text), 'loan|portfolio') THEN 'Reporting' WHEN regexp_matches(lower(text), 'customer|client') THEN 'Customer Handling' WHEN regexp_matches(lower(text), 'risk|compliance') THEN 'Compliance' WHEN regexp_matches(lower(text), 'overdue|collection') THEN 'Collections' END AS category, count(*) AS "count" FROM conversations GROUP BY 1""")

digest = lambda d, *by: d.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"), F.max(F.length("content")).cast("long").alias("longest"))
LAST = "greatest(ceil((length(text) - 200) / 1400.0)::BIGINT - 1, 0)"
C.on("k01_fixed_windows", "documents", ch.fixed_windows, f"""WITH d AS (SELECT doc_id, text, length(text) AS n, {LAST} AS last FROM documents WHERE length(text) > 0), m AS (SELECT *, last > 0 AND n - last * 1400 < 80 AND n - (last - 1) * 1400 <= 3000 AS mg FROM d),
 x AS (SELECT *, unnest(range(0, CASE WHEN mg THEN last ELSE last + 1 END)) AS i FROM m) SELECT doc_id, i::INT AS chunk_index, substr(text, (i * 1400 + 1)::BIGINT, CASE WHEN mg AND i = last - 1 THEN n - i * 1400 ELSE 1600 END) AS content FROM x""")
C.on("k03_sentence_chunks", "documents", lambda d: digest(ch.sentence_chunks(d), "doc_id"))
C.on("k04_paragraph_chunks", "documents", lambda d: digest(ch.paragraph_chunks(d, pattern="\n"), "doc_id"))
C.on("s06_line_blocks", "documents", lambda d: ch.line_blocks(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("is_heading").alias("headings")), r"""WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '^ +', ''), ' +$', '') AS b FROM documents) SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE regexp_matches(b, '^[\p{Lu}0-9]') AND length(b) BETWEEN 2 AND 81 AND len(string_split_regex(b, '\s+')) <= 12) AS headings FROM x WHERE b != '' GROUP BY doc_id""")
C.on("k02_structured_chunks", "documents", lambda d: digest(ch.structured_chunks(ch.line_blocks(d)), "doc_id"))
C.on("k05_table_chunks", "documents", lambda d: digest(ch.table_chunks(d), "doc_id"))
C.on("k06_parents_and_children", "documents", lambda d: ch.parents_and_children(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("parent_id").alias("children")), "SELECT doc_id, (2 * count(*))::BIGINT AS chunks, count(*) AS children FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) WHERE trim(s) != '' GROUP BY doc_id")
C.on("k08_automatic", "documents", lambda d: ch.automatic(d).groupBy("strategy").count())
C.on("k09_recursive_chunks", "documents", lambda d: digest(ch.recursive_chunks(d), "doc_id"), r"""
WITH RECURSIVE d AS (
  SELECT doc_id, t, length(t) AS n FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents) WHERE t != ''),
w AS (
  SELECT doc_id, 0::BIGINT AS b, NULL::BIGINT AS e FROM d
  UNION ALL
  SELECT doc_id, CASE WHEN e IS NULL THEN b ELSE e - 100 END, CASE WHEN e IS NULL THEN cut END
  FROM (
    SELECT w.doc_id, b, e, n,
           CASE WHEN b + 800 >= n THEN n
                WHEN strpos(r, chr(10) || chr(10)) > 0 THEN b + 800 - strpos(r, chr(10) || chr(10)) + 1
                WHEN strpos(r, chr(10)) > 0 THEN b + 800 - strpos(r, chr(10)) + 1
                WHEN strpos(r, ' ') > 0 THEN b + 800 - strpos(r, ' ') + 1
                ELSE b + 800 END AS cut
    FROM (SELECT w.*, d.n, reverse(substring(d.t, b + 102, 699)) AS r FROM w JOIN d USING (doc_id)) AS w)
  WHERE e IS NULL OR e < n),
c AS (
  SELECT doc_id, regexp_replace(substring(t, b + 1, e - b), '^\s+|\s+$', '', 'g') AS c FROM w JOIN d USING (doc_id) WHERE e IS NOT NULL)
SELECT doc_id, count(*) AS chunks, sum(length(c))::BIGINT AS chars, max(length(c))::BIGINT AS longest FROM c WHERE c != '' GROUP BY 1""")
C.on("k11_finalize", "documents", lambda d: ch.finalize(ch.fixed_windows(d)).groupBy("doc_id").agg(F.count("chunk_index").alias("kept"), F.count("reject_reason").alias("rejected"), F.sum("token_count").alias("tokens")))
C.on("k13_hierarchy", "documents", lambda d: ch.hierarchy(ch.line_blocks(d)))
C.on("k12_token_estimate", "conversations", lambda d: d.select("conv_id", "turn", ch.token_estimate("text").alias("tokens")), f"SELECT conv_id, turn, greatest({WORDS}, 1)::BIGINT AS tokens FROM conversations")


ASKED = ("item_id % 50 = 0", "vec_id % 50 = 0")  #: the rows that are queries of a search; they grow with the tables


def ask(s, d, which=ASKED):
    return read(s, d, "benchmark").where(which[0]).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def ask_vectors(s, d, which=ASKED):
    return read(s, d, "embeddings").where(which[1]).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x != '')"
C.free("v02_bm25", lambda s, d: re_.bm25(read(s, d, "documents"), ask(s, d)).select("query_id", "doc_id", F.round("score", 4).alias("score")), f"""WITH w AS (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM (SELECT doc_id, {TOKENS} AS t FROM documents)), q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark WHERE item_id % 50 = 0),
 st AS (SELECT count(*) AS c, avg(len(t)) AS a FROM (SELECT {TOKENS} AS t FROM documents)), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (c - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / a))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)
 SELECT query_id, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS i FROM sc) WHERE i <= 10""")


def searched(metric: str) -> str:
    e, f = "e.embedding::DOUBLE[]", "q.embedding::DOUBLE[]"
    dot = f"list_dot_product({e}, {f})"
    gap = f"list_sum(list_transform(list_zip({e}, {f}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    score = {"dot": dot, "cosine": f"{dot} / (sqrt(list_dot_product({e}, {e})) * sqrt(list_dot_product({f}, {f})))", "l2": f"1 / (1 + {gap})"}[metric]
    return f"SELECT query_id, vec_id, round(score, 4) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round({score}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({score}, 6) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5"


COSINE, DOT, L2 = (searched(m).split(" FROM (", 1)[1].rsplit(") WHERE", 1)[0] for m in ("cosine", "dot", "l2"))
HYBRID = f"""WITH t AS ({C.sql["v02_bm25"].replace("round(score, 4) AS score", "score").replace("i <= 10", "i <= 20")}), v AS (SELECT query_id, vec_id AS doc_id, score FROM ({COSINE}) WHERE rank <= 20),
 u AS (SELECT *, 'terms' AS s FROM t UNION ALL SELECT *, 'vectors' FROM v), p AS (SELECT query_id, doc_id, max(score) AS score, CASE WHEN count(DISTINCT s) > 1 THEN 'both' ELSE min(s) END AS source FROM u GROUP BY 1, 2)
 SELECT query_id, doc_id, source, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p) WHERE rank <= 10"""
RERANK = f"""WITH c AS (SELECT query_id, vec_id FROM ({COSINE}) WHERE rank <= 20), d AS (SELECT query_id, vec_id, score FROM ({DOT}) JOIN c USING (query_id, vec_id))
 SELECT query_id, vec_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= 5"""
RECALL = f"""WITH a AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS i FROM ({L2}) JOIN embeddings USING (vec_id))
 SELECT query_id, vec_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM a WHERE i <= 3) WHERE rank <= 3"""
PARTS = r"""(SELECT item_id, list_filter(list_transform(string_split_regex(text, '(?i)\s+and\s+|\s+or\s+|,|/'), lambda x: trim(x)), lambda x: length(x) > 8)[1:5] AS p, text FROM benchmark WHERE item_id % 50 = 0)"""
SPLIT = r"string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2))"
RETRIEVED = f"""WITH a AS (SELECT item_id AS query_id, unnest(CASE WHEN len(p) > 0 THEN p ELSE [text] END) AS query, unnest(range(CASE WHEN len(p) > 0 THEN len(p) ELSE 1 END)) AS nth FROM {PARTS}),
 qw AS (SELECT DISTINCT query_id, nth, unnest({TOKENS.replace("text", "query")}) AS term FROM a), w AS (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM (SELECT doc_id, {TOKENS} AS t FROM documents)),
 st AS (SELECT count(*) AS c, avg(len(t)) AS a FROM (SELECT {TOKENS} AS t FROM documents)), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM qw) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 sc AS (SELECT query_id, nth, doc_id, round(sum(ln(1 + (c - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / a))), 6) AS score FROM qw JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2, 3),
 te AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, nth ORDER BY score DESC, doc_id) AS i FROM sc) WHERE i <= 20 GROUP BY 1, 2),
 ve AS (SELECT query_id, vec_id AS doc_id, score FROM ({COSINE.replace("q.vec_id % 50 = 0", "q.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 50 = 0)")}) WHERE rank <= 20),
 fo AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM te UNION ALL SELECT * FROM ve) GROUP BY 1, 2), ca AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS i FROM fo) WHERE i <= 20),
 do_ AS (SELECT query_id, vec_id AS doc_id, score FROM ({DOT.replace("q.vec_id % 50 = 0", "q.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 50 = 0)")})),
 be AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ca JOIN do_ USING (query_id, doc_id)),
 se AS (SELECT query_id, doc_id, s, i, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY len(list_intersect(list_distinct({TOKENS.replace("text", "s")}), list_distinct({TOKENS.replace("text", "q")}))) DESC, i) AS k
  FROM (SELECT query_id, doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i, q FROM (SELECT be.query_id, be.doc_id, {SPLIT.replace("text", "d.text")} AS p, b.text AS q FROM be JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = be.query_id WHERE rank <= 5))),
 co AS (SELECT query_id, doc_id, length(string_agg(s, ' ' ORDER BY k)) AS chars FROM se WHERE k <= 3 GROUP BY 1, 2)
 SELECT query_id, doc_id, rank, chars::INT AS chars FROM be LEFT JOIN co USING (query_id, doc_id) WHERE rank <= 5"""


for id_, metric in (("v03", "dot"), ("v04", "cosine"), ("v05", "l2")):
    C.free(f"{id_}_{metric}_search", lambda s, d, m=metric: ve.vector_search(read(s, d, "embeddings"), ask_vectors(s, d), 5, m).withColumn("score", F.round("score", 4)), searched(metric))
C.free("v07_filtered_search", lambda s, d: ve.vector_search(read(s, d, "embeddings"), ask_vectors(s, d), 5, "cosine", where=F.col("label") == 3).withColumn("score", F.round("score", 4)), searched("cosine").replace("q.vec_id % 50 = 0)", "q.vec_id % 50 = 0 AND e.label = 3)"))
C.on("v16_invalid_vectors", "embeddings", lambda d: re_.invalid_vectors(d, "embedding", 64).groupBy("reason").count(), 'SELECT \'width\' AS reason, count(*) AS "count" FROM embeddings WHERE len(embedding) != 64 HAVING count(*) > 0')
C.free(
    "v08_hybrid",
    lambda s, d: re_.hybrid(re_.bm25(read(s, d, "documents"), ask(s, d), 20), ve.vector_search(read(s, d, "embeddings"), ask_vectors(s, d), 20).withColumnRenamed("vec_id", "doc_id"), 10).select("query_id", "doc_id", "source", "rank"),
    HYBRID,
)
C.free(
    "v09_rerank",
    lambda s, d: re_.rerank(ve.vector_search(read(s, d, "embeddings"), ask_vectors(s, d), 20, "cosine"), read(s, d, "embeddings"), ask_vectors(s, d), 5).select("query_id", "vec_id", "rank"),
    RERANK,
)
C.free("v06_approximate_search", lambda s, d: ve.approximate_search(read(s, d, "embeddings"), ask_vectors(s, d), 5).select("query_id", "vec_id", "rank"))
C.on("v10_sub_queries", "benchmark", lambda d: d.select("item_id", F.size(re_.sub_queries("text")).alias("parts")))
C.on("v13_needs_search", "conversations", lambda d: d.groupBy(re_.needs_search("text").alias("search")).count(), """SELECT regexp_matches(lower(text), 'trend|compare|over the last|repayment|default|rate|which|who') AS search, count(*) AS "count" FROM conversations GROUP BY 1""")

#: Hybrid search among the documents of one language and an open source, cut before or after the search.
OPEN = "lang = 'en' AND n_chars < 4000"
FILTERED = f"""
WITH ok AS (SELECT doc_id FROM documents WHERE {OPEN}),
docs AS (SELECT * FROM documents WHERE [pre]),
vecs AS (SELECT * FROM embeddings WHERE [pre_vec]),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark WHERE item_id % 50 = 0),
w AS (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM (SELECT doc_id, {TOKENS} AS t FROM docs)),
st AS (SELECT count(*) AS c, avg(len(t)) AS a FROM (SELECT {TOKENS} AS t FROM docs)),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (c - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / a))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
te AS (SELECT query_id, doc_id, score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20),
l2 AS (
  SELECT q.vec_id AS query_id, e.vec_id AS doc_id,
         round(1 / (1 + list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS score
  FROM vecs e, embeddings q WHERE q.vec_id % 50 = 0),
ne AS (SELECT query_id, doc_id, score FROM l2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 60),
u AS (SELECT *, 'terms' AS s FROM te UNION ALL SELECT *, 'vectors' FROM ne),
p AS (
  SELECT query_id, doc_id, max(score) AS score, CASE WHEN count(DISTINCT s) > 1 THEN 'both' ELSE min(s) END AS source
  FROM u WHERE [post] GROUP BY 1, 2)
SELECT query_id, doc_id, source, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p) WHERE rank <= 20
"""


def filtered(s, d, mode):
    docs = read(s, d, "documents")
    found = re_.hybrid_search(docs, read(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), ask(s, d), ask_vectors(s, d), 20, docs, F.expr(OPEN), mode)
    return found.select("query_id", "doc_id", "source", "rank")


for mode, pre, post in (("pre", "doc_id IN (SELECT doc_id FROM ok)", "true"), ("post", "true", "doc_id IN (SELECT doc_id FROM ok)")):
    sql = FILTERED.replace("[pre]", pre).replace("[pre_vec]", pre.replace("doc_id IN", "vec_id IN")).replace("[post]", post)
    C.free(f"v08_hybrid_{mode}", lambda s, d, m=mode: filtered(s, d, m), sql)


def whole_way(s, d):
    vecs = read(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = ask(s, d)
    own = asked.select("query_id").join(vecs.withColumnRenamed("doc_id", "query_id"), "query_id").withColumnRenamed("embedding", "query_vector")
    return re_.retrieve(read(s, d, "documents"), vecs, asked, own)


C.free("v12_retrieve", lambda s, d: whole_way(s, d).select("query_id", "doc_id", "rank", F.length("content").alias("chars")), RETRIEVED)
C.free("v15_packed_context", lambda s, d: re_.packed_context(whole_way(s, d).where("content is not null")).select("query_id", "used", "left_out"))
C.free("v14_merged_results", lambda s, d: re_.merged_results(read(s, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").alias("score")), read(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"), F.lit(5).alias("score"))), "SELECT doc_id AS chunk_id, CASE WHEN toxic = 1 THEN 5 ELSE quality END::INT AS score, CASE WHEN toxic = 1 THEN 'both' ELSE 'local' END AS source FROM labels")


def guarded(s, d):
    n = F.pmod("doc_id", F.lit(5))
    return read(s, d, "documents").select(
        "doc_id", F.concat(F.lit("t"), (F.col("doc_id") % 2).cast("string")).alias("tenant_id"), F.element_at(F.array(*[F.lit(x) for x in ("public", "internal", "confidential", "restricted", "secret")]), (n + 1).cast("int")).alias("classification"),
        F.when(n == 1, F.array(F.lit("u1"))).otherwise(F.array().cast("array<string>")).alias("allowed_users"), F.when(n == 2, F.array(F.lit("analyst"))).otherwise(F.array().cast("array<string>")).alias("allowed_roles"),
        F.array().cast("array<string>").alias("allowed_departments"), F.lit("u9").alias("owner_id"),
    )


def readers(s):
    return s.createDataFrame([("u1", "t0", "confidential", ["clerk"], []), ("u2", "t1", "restricted", ["analyst"], []), ("u9", "t0", "restricted", [], [])], "user_id string, tenant_id string, clearance string, roles array<string>, departments array<string>")


C.free("c02_visibility", lambda s, d: re_.visibility(guarded(s, d), readers(s)), """WITH g AS (SELECT doc_id, doc_id % 2 AS t, doc_id % 5 AS n FROM documents) SELECT 'u1' AS user_id, count(*) AS visible FROM g WHERE t = 0 AND n IN (0, 1) UNION ALL SELECT 'u2', count(*) FROM g WHERE t = 1 AND n IN (0, 2, 3) UNION ALL SELECT 'u9', count(*) FROM g WHERE t = 0 AND n <= 3""")
C.free("c01_access_filter", lambda s, d: guarded(s, d).where(re_.may_read(F.lit("t0"), "internal", F.lit("u1"), F.array().cast("array<string>"), F.array().cast("array<string>"))).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 IN (0, 1)")
graph = lambda s, d: re_.edges_from(read(s, d, "customer").join(read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")), [("nation", "c_nationkey", "manages", "customer", "c_custkey"), ("customer", "c_custkey", "has", "order", "o_orderkey")])
EDGES = "WITH g AS (SELECT DISTINCT 'nation:' || c_nationkey AS src, 'manages' AS rel, 'customer:' || c_custkey AS dst FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT DISTINCT 'customer:' || c_custkey, 'has', 'order:' || o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey)"
C.free("g01_graph", graph, EDGES + " SELECT * FROM g")
C.free("g02_walk", lambda s, d: re_.walk(graph(s, d), s.createDataFrame([("nation:3",)], "node string"), 2), EDGES + " SELECT src, rel, dst, 1::INT AS depth FROM g WHERE src = 'nation:3' UNION ALL SELECT src, rel, dst, 2 FROM g WHERE src IN (SELECT dst FROM g WHERE src = 'nation:3')")

C.on("e01_cache_keys", "documents", lambda d: d.select("doc_id", me.cache_key("text", "hash").alias("k")), "SELECT doc_id, sha256('hash|1|64|true|' || text) AS k FROM documents")
C.free("e02_embed", lambda s, d: me.embed_incrementally(read(s, d, "conversations"), s.createDataFrame([], "cache_key string, vector array<float>"), me.hashing_embedder(), "hash")[0].select("conv_id", "turn", F.size("vector").alias("width")), "SELECT conv_id, turn, 64::INT AS width FROM conversations")
ITEMS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'new' ELSE 'done' END"
C.on("e04_job_status", "events", lambda d: me.job_status(d.select(F.col("user_id").alias("job_id"), F.expr(ITEMS).alias("status"))), f"SELECT user_id AS job_id, count(*) AS items, {cnt(ITEMS + chr(61) + chr(39) + 'done' + chr(39))} AS done, {cnt(ITEMS + chr(61) + chr(39) + 'failed' + chr(39))} AS failed, round({cnt(ITEMS + chr(61) + chr(39) + 'done' + chr(39))} * 100.0 / count(*), 2) AS progress, 'running' AS state FROM events GROUP BY 1")
C.on("e05_timings", "events", lambda d: me.timings(d, "event_type", "value"), "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(max(value), 4) AS longest FROM events GROUP BY 1")
C.on("y01_memory_types", "events", lambda d: d.groupBy(me.memory_type(F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 3 == 0, "workflow").when(F.col("event_id") % 3 == 1, "rule"))).alias("type")).count(), """SELECT CASE event_id % 3 WHEN 0 THEN 'procedural' WHEN 1 THEN 'semantic' ELSE 'episodic' END AS type, count(*) AS "count" FROM events GROUP BY 1""")
C.on("y02_entity_index", "events", lambda d: me.entity_index(d.withColumn("e", F.array(F.concat(F.lit("U"), F.col("user_id").cast("string")))), "e", ["ts", "event_id"], "event_type"), "SELECT 'U' || user_id AS entity, count(*) AS events, (SELECT string_agg(event_type, '|' ORDER BY ts, event_id) FROM (SELECT * FROM events x WHERE x.user_id = v.user_id ORDER BY ts DESC, event_id DESC LIMIT 3)) AS last FROM events v GROUP BY user_id")
C.free("y03_action_taken", lambda s, d: me.action_taken(read(s, d, "events").select(F.col("user_id").alias("entity"), F.lit("purch").alias("phrase")).distinct(), read(s, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("summary"))), "SELECT DISTINCT user_id AS entity, 'purch' AS phrase FROM events WHERE event_type = 'purchase'")
C.on("y05_session_context", "conversations", lambda d: me.lines_of(d, "conv_id", ["turn"], F.format_string("%d %s", "turn", "role"), 10), "SELECT conv_id, substr(string_agg(turn || ' ' || role, chr(10) ORDER BY turn), 1, 800) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) WHERE i <= 10 GROUP BY 1")
C.on("y06_session_counters", "events", lambda d: me.session_counters(d, "user_id", "event_type", "props"), "SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, count(DISTINCT props) AS entities FROM events GROUP BY 1")
C.on("y07_conversation_window", "events", lambda d: me.last_rows(d.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 25).select("user_id", "event_id"), "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i <= 25")
STATES = ("click", "error", "purchase", "signup", "view")
C.on("y08_tool_audit", "events", lambda d: me.tool_audit(d, "user_id", "event_type", STATES, "value"), "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in STATES) + ", count(*) AS calls, round(avg(value), 4) AS mean_duration, round(max(value), 4) AS max_duration FROM events GROUP BY 1")

C.on("t01_error_rate", "events", lambda d: jobs.error_rate(d).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "errors", "rate", "anomalous"), """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*), 4) AS rate, round(count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*), 4) > 5 AS anomalous FROM events GROUP BY date_trunc('hour', ts)""")
C.on("t02_daily_events", "events", lambda d: jobs.windowed_counts(d).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n"), "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
C.on("t03_sessions", "events", lambda d: jobs.sessions(d).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events")), """SELECT user_id, (count(*) FILTER (WHERE p IS NULL OR ts >= p + INTERVAL 30 MINUTE)) AS sessions, count(*)::BIGINT AS events FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) GROUP BY 1""")

C.over("x01_mail", "mails", lambda d: do.mail_summary(d, "sender", "recipient", "subject", "body", "day"), """SELECT count(*) AS mails, count(DISTINCT sender) AS senders, count(DISTINCT recipient) AS recipients, round(avg(length(subject)), 4) AS mean_subject, count(*) FILTER (WHERE regexp_matches(concat_ws(' ', subject, body), '(?i)urgent|important|asap')) AS urgent,
 (SELECT day FROM v GROUP BY day ORDER BY count(*) DESC, day DESC LIMIT 1) AS peak_day, (SELECT round(avg(k), 4) FROM (SELECT count(*) AS k FROM v GROUP BY day)) AS per_day FROM v""")
C.over("x06_pages", "files", do.page_statistics, """SELECT count(*) AS documents, sum(page_count)::BIGINT AS pages, round(avg(page_count), 4) AS mean_pages, max(page_count)::BIGINT AS max_pages, min(page_count)::BIGINT AS min_pages, sum(length(text_content))::BIGINT AS chars, count(*) FILTER (WHERE length(text_content) = 0) AS empty,
 round(sum(file_size) / 1048576, 4) AS megabytes, count(DISTINCT filename) AS names, count(filename) - count(DISTINCT filename) AS duplicate_names, count(*) FILTER (WHERE d > 100) AS dense, count(*) FILTER (WHERE d >= 50 AND d <= 100) AS moderate, count(*) FILTER (WHERE d < 50) AS sparse FROM (SELECT *, length(text_content) / (page_count + 1e-4) AS d FROM v)""")
C.over("x10_images", "files", lambda d: do.image_statistics(d), """SELECT (SELECT q FROM (SELECT round(width / height, 2) AS q, count(*) AS k FROM v GROUP BY 1) ORDER BY k DESC, q LIMIT 1) AS modal_ratio, round(avg(width), 4) AS mean_width, round(avg(height), 4) AS mean_height, round(sum(file_size) / 1024, 4) AS kilobytes, count(*) FILTER (WHERE p <= 307200) AS low, count(*) FILTER (WHERE p > 307200 AND p <= 921600) AS sd, count(*) FILTER (WHERE p > 921600 AND p <= 2073600) AS hd,
 count(*) FILTER (WHERE p > 2073600) AS uhd FROM (SELECT *, width::BIGINT * height AS p FROM v)""")
C.on("x21_entity_ids", "orders", lambda d: d.select("o_orderkey", F.array_join(do.entity_ids(F.concat(F.lit("for cust"), F.col("o_custkey").cast("string"), F.lit(" and LOAN"), F.col("o_orderkey").cast("string"))), ",").alias("ids")), "SELECT o_orderkey, 'CUST' || o_custkey || ',LOAN' || o_orderkey AS ids FROM orders")
C.free("y04_recall", lambda s, d: ve.recall(read(s, d, "embeddings"), ask_vectors(s, d), "label", 3).select("query_id", "vec_id", "rank"), RECALL)
C.on("y09_latest_activity", "events", lambda d: me.lines_of(d, "user_id", ["ts", "event_id"], F.format_string("%d %s", "event_id", "event_type"), 5, 10_000), "SELECT user_id, string_agg(event_id || ' ' || event_type, chr(10) ORDER BY ts, event_id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i <= 5 GROUP BY 1")
C.on("v11_compressed", "documents", lambda d: re_.compressed(d, "the of and").select("doc_id", F.length("content").alias("chars")))
C.on("s05_paragraphs", "pages", lambda d: d.select("page_id", F.explode(F.split("html", "<p>")).alias("b")).groupBy("page_id").count(), """SELECT page_id, count(*) AS "count" FROM (SELECT page_id, unnest(string_split(html, '<p>')) FROM pages) GROUP BY 1""")

C.on(
    "e03_reembed", "conversations", lambda d: me.reembed(d, me.hashing_embedder(32), "hash-2", most=400)[1],
    """SELECT count(*) FILTER (WHERE length(text) <= 400) AS succeeded, count(*) FILTER (WHERE length(text) > 400) AS failed, count(DISTINCT text) FILTER (WHERE length(text) <= 400) AS embedded FROM conversations""",
)

C.sql.update(CHUNK_SQL)
