"""Term and vector search, access rules, graph walks, packing of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.core import col, r
from tessera.operators.vectors import top, vector_search

#: Ranks of classifications; words that call for a search.
RANKS = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3}
SEARCH_WORDS = ("trend", "compare", "over the last", "repayment", "default", "rate", "which", "who")
#: Queries of a search that may be broadcast, each one short row.
QUERY_LIMIT = 20_000


def tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def _small(queries: DataFrame) -> DataFrame:
    return F.broadcast(queries) if queries.limit(QUERY_LIMIT + 1).count() <= QUERY_LIMIT else queries


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, key, score, rank: Okapi BM25 of (query_id, query) over all texts.

    Only terms of the queries are kept from the texts, so the shuffle holds their postings, not the corpus.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
    words = docs.select(key, tokens(text).alias("_t")).withColumn("_len", F.size("_t"))
    stats = words.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"))
    hits = words.select(key, "_len", F.explode("_t").alias("term")).join(_small(asked.select("term").distinct()), "term", "left_semi")
    tf = hits.groupBy(key, "_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = tf.join(df, "term").join(F.broadcast(stats))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    scored = rows.withColumn("_w", weight).join(_small(asked), "term").groupBy("query_id", key).agg(r(F.sum("_w"), 6).alias("score"))
    return top(scored, "query_id", "score", key, k)


def dot(a: str | Column, b: str | Column) -> Column:
    both = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y)
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def invalid_vectors(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Rows whose vector is null, of another width or not finite, with the reason."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    why = F.when(F.col(vector).isNull(), "missing").when(F.size(vector) != width, "width").when(bad, "not finite")
    return df.withColumn("reason", why).where("reason is not null")


def hybrid(terms: DataFrame, vectors: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """query_id, key, score, source, rank: the better of a row's two scores."""
    both = terms.select("query_id", key, "score", F.lit("terms").alias("_s")).unionByName(vectors.select("query_id", key, "score", F.lit("vectors").alias("_s")))
    per = both.groupBy("query_id", key).agg(F.max("score").alias("score"), F.count_distinct("_s").alias("_n"), F.min("_s").alias("_s"))
    return top(per.select("query_id", key, "score", F.when(F.col("_n") > 1, "both").otherwise(F.col("_s")).alias("source")), "query_id", "score", key, k)


def hybrid_search(
    docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 20,
    meta: DataFrame | None = None, where: Column | None = None, filter_mode: str = "pre", key: str = "doc_id", text: str = "text", vector: str = "embedding",
) -> DataFrame:
    """query_id, key, score, source, rank: the k best of the union of k term hits and max(3 k, 50) neighbours by 1 / (1 + d * d).

    ``where`` is a condition on the rows of ``meta`` (key and any columns: metadata, access rules). ``pre`` searches
    only among the rows that meet it; ``post`` cuts the candidates first and then drops those that don't, so fewer than k may
    be left. Rows without a row in ``meta`` don't meet it.
    """
    if filter_mode not in ("pre", "post"):
        raise ValueError("filter_mode is pre or post")
    allowed = None if where is None or meta is None else meta.where(where).select(key).distinct()
    if allowed is not None and filter_mode == "pre":
        docs, vectors = docs.join(allowed, key, "left_semi"), vectors.join(allowed, key, "left_semi")
    terms = bm25(docs, queries, k, key=key, text=text).select("query_id", key, "score", F.lit("terms").alias("_s"))
    near = vector_search(vectors, query_vectors, max(3 * k, 50), "l2", key, vector).select("query_id", key, "score", F.lit("vectors").alias("_s"))
    both = terms.unionByName(near)
    if allowed is not None and filter_mode == "post":
        both = both.join(allowed, key, "left_semi")
    per = both.groupBy("query_id", key).agg(F.max("score").alias("score"), F.count_distinct("_s").alias("_n"), F.min("_s").alias("_s"))
    return top(per.select("query_id", key, "score", F.when(F.col("_n") > 1, "both").otherwise(F.col("_s")).alias("source")), "query_id", "score", key, k)


def merged_results(local: DataFrame, remote: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, score, source: the higher score of two result lists."""
    a, b = local.select(key, F.col("score").alias("_a")), remote.select(key, F.col("score").alias("_b"))
    out = a.join(b, key, "full_outer")
    source = F.when(F.col("_a").isNull(), "remote").when(F.col("_b").isNull(), "local").otherwise("both")
    return out.select(key, F.greatest("_a", "_b").alias("score"), source.alias("source"))


def sub_queries(c: str | Column) -> Column:
    """Parts of more than 8 characters between "and", "or", comma and slash, five at most; else the whole."""
    parts = F.slice(F.filter(F.transform(F.split(col(c), r"(?i)\s+and\s+|\s+or\s+|,|/"), lambda x: F.trim(x)), lambda x: F.length(x) > 8), 1, 5)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(col(c)))


def needs_search(c: str | Column) -> Column:
    return F.lower(col(c)).rlike("|".join(SEARCH_WORDS))


def compressed(df: DataFrame, query: str, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """key, content: the sentences that share most words with the query, best first."""
    wanted = tokens(F.lit(query))
    rows = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+")).alias("_i", "_s"))
    rows = rows.withColumn("_hit", F.size(F.array_intersect(F.array_distinct(tokens("_s")), F.array_distinct(wanted))))
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_hit"), "_i"))).where(F.col("_r") <= most)
    order = F.array_sort(F.collect_list(F.struct("_r", "_s")))
    return best.groupBy(key).agg(F.array_join(F.transform(order, lambda x: x["_s"]), " ").alias("content"))


def packed_context(df: DataFrame, budget: int = 3000, by: str = "query_id", content: str = "content") -> DataFrame:
    """by, context, used, left_out: results in order of score until the budget is spent; the first always stays."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), content)
    rows = df.withColumn("_line", F.format_string("[%.2f] %s", F.col("score"), F.col(content)))
    rows = rows.withColumns({"_i": F.row_number().over(w), "_sum": F.sum(F.length("_line")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    fits = (F.col("_i") == 1) | (F.col("_sum") <= budget)
    order = F.array_sort(F.collect_list(F.when(fits, F.struct("_i", "_line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(order, lambda x: x["_line"]), "\n").alias("context"), F.count_if(fits).alias("used"), F.count_if(~fits).alias("left_out"))


def may_read(tenant: Column, clearance: str | Column, user: Column, roles: Column, departments: Column) -> Column:
    """Whether a row (tenant_id, classification, allowed_users, allowed_roles, allowed_departments, owner_id) is open to a user.

    The tenant must be equal and the classification known and within the clearance (none is public). An owner or an
    admin role passes; else at least one of the lists must name the user, unless all are empty.
    """
    table = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    rank = F.try_element_at(table, F.coalesce(F.lower("classification"), F.lit("public")))
    allowed = rank.isNotNull() & (rank <= F.try_element_at(table, F.lower(clearance if isinstance(clearance, Column) else F.lit(clearance))))
    empty = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)) <= 0
    listed = F.array_contains("allowed_users", user) | F.arrays_overlap("allowed_roles", roles) | F.arrays_overlap("allowed_departments", departments)
    free = empty("allowed_users") & empty("allowed_roles") & empty("allowed_departments")
    owner = F.col("owner_id").eqNullSafe(user) | F.array_contains(roles, F.lit("admin"))
    return F.coalesce((F.col("tenant_id") == tenant) & allowed & (free | owner | F.coalesce(listed, F.lit(False))), F.lit(False))


def visibility(docs: DataFrame, users: DataFrame, key: str = "doc_id") -> DataFrame:
    """user_id, visible: how many documents each user may read by may_read(); users who may read none are left out.

    No user meets a document. Each restricted document is turned into the principals that may read it (its users, owner, roles
    and departments), and documents of one tenant, rank and set of principals are one class with a count. Users meet the classes by
    principal, each class once, however many principals lead to it; open documents, and all for admins, are counts by
    tenant and rank.
    """
    table = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    rank_of = lambda c: F.try_element_at(table, F.lower(c))
    named = lambda kind, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{kind}:"), x.cast("string")))
    lists = {"user": "allowed_users", "role": "allowed_roles", "department": "allowed_departments"}
    free = F.lit(True)
    for c in lists.values():
        free = free & (F.coalesce(F.size(c), F.lit(0)) <= 0)
    owner = F.array(F.concat(F.lit("user:"), F.col("owner_id").cast("string")))
    who = F.array_sort(F.array_distinct(F.array_compact(F.concat(owner, *[named(k, c) for k, c in lists.items()]))))
    rows = docs.where(F.col(key).isNotNull() & F.col("tenant_id").isNotNull()).select("tenant_id", rank_of(F.coalesce("classification", F.lit("public"))).alias("rank"), free.alias("free"), F.when(free, None).otherwise(who).alias("who"))
    classes = rows.where("rank is not null").groupBy("tenant_id", "rank", "free", "who").agg(F.count(F.lit(1)).alias("n"))
    per_rank = classes.groupBy("tenant_id", "rank").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("free"), F.col("n")).otherwise(0)).alias("open"))
    upto = per_rank.withColumn("clearance", F.explode(F.sequence(F.col("rank"), F.lit(max(RANKS.values()))))).groupBy("tenant_id", "clearance").agg(F.sum("all").alias("all"), F.sum("open").alias("open"))

    mine = F.array_distinct(F.array_compact(F.concat(F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string"))), named("role", "roles"), named("department", "departments"))))
    asked = users.select("user_id", "tenant_id", rank_of("clearance").alias("clearance"), F.coalesce(F.array_contains("roles", "admin"), F.lit(False)).alias("admin"), mine.alias("who"))
    by_class = classes.where("not free").select("tenant_id", "rank", "n", "who", F.explode("who").alias("principal"))
    grants = asked.where("not admin").select("user_id", "tenant_id", "clearance", F.explode("who").alias("principal"))
    granted = grants.join(by_class, ["tenant_id", "principal"]).where("rank <= clearance").groupBy("user_id", "tenant_id", "rank", "who").agg(F.max("n").alias("n"))
    granted = granted.groupBy("user_id").agg(F.sum("n").alias("granted"))
    found = asked.join(upto, ["tenant_id", "clearance"], "left").join(granted, "user_id", "left")
    count = F.coalesce(F.when(F.col("admin"), F.col("all")).otherwise(F.coalesce("open", F.lit(0)) + F.coalesce("granted", F.lit(0))), F.lit(0))
    return found.select("user_id", count.cast("long").alias("visible")).where("visible > 0")


def edges_from(df: DataFrame, chain: Sequence[tuple[str, str, str, str, str]]) -> DataFrame:
    """src, rel, dst from (kind, column, relation, kind, column) steps, without repeats and nulls."""
    out = None
    for a, x, rel, b, y in chain:
        one = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.concat(F.lit(f"{a}:"), F.col(x).cast("string")).alias("src"), F.lit(rel).alias("rel"), F.concat(F.lit(f"{b}:"), F.col(y).cast("string")).alias("dst"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def walk(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """src, rel, dst, depth: edges reached from the nodes of ``start`` (column node) within ``depth`` steps."""
    front, seen, found = start.select("node").distinct(), start.select("node").distinct(), None
    for step in range(1, depth + 1):
        hop = edges.join(front.withColumnRenamed("node", "src"), "src", "left_semi").withColumn("depth", F.lit(step))
        found = hop if found is None else found.unionByName(hop)
        front = hop.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.unionByName(front)
    return found.groupBy("src", "rel", "dst").agg(F.min("depth").alias("depth"))


def chunk_id(doc: str | Column, index: str | Column, filename: str | Column, text: str | Column) -> Column:
    """Document and number; without a document the file's name and a hash of the text."""
    fallback = F.concat_ws("-", F.coalesce(col(filename), F.lit("unknown")), F.pmod(F.xxhash64(F.coalesce(col(text), F.lit(""))), F.lit(10_000)).cast("string"))
    return F.coalesce(F.concat(col(doc).cast("string"), F.lit("_"), col(index).cast("string")), fallback)


def mentioned_walk(edges: DataFrame, queries: DataFrame, depth: int = 3, kind: str = "officer") -> DataFrame:
    """query_id, src, rel, dst, depth: edges reached from the node that a query names ("officer 3", "Officer: 3")."""
    name = F.regexp_extract("query", rf"(?i){kind}[: ]?(\w+)", 1)
    front = queries.select("query_id", F.when(name != "", F.concat(F.lit(f"{kind}:"), name)).alias("node")).where("node is not null")
    seen, found = front, None
    for step in range(1, depth + 1):
        hop = edges.join(front.withColumnRenamed("node", "src"), "src").select("query_id", "src", "rel", "dst", F.lit(step).alias("depth"))
        found = hop if found is None else found.unionByName(hop)
        front = hop.select("query_id", F.col("dst").alias("node")).distinct().join(seen, ["query_id", "node"], "left_anti")
        seen = seen.unionByName(front)
    return found.groupBy("query_id", "src", "rel", "dst").agg(F.min("depth").alias("depth"))


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, rank: the candidates (query_id, key) by dot product with their query's vector, the best k."""
    both = candidates.select("query_id", key).distinct().join(vectors.select(key, vector), key).join(queries.select("query_id", "query_vector"), "query_id")
    return top(both.select("query_id", key, r(dot(vector, "query_vector"), 6).alias("score")), "query_id", "score", key, k)


def compressed_for(results: DataFrame, docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """Adds content to (query_id, key, ...): of each text the sentences that share most words with its query, best first."""
    wanted = queries.select("query_id", F.array_distinct(tokens("query")).alias("_wanted"))
    rows = results.select("query_id", key).distinct().join(docs.select(key, text), key).join(_small(wanted), "query_id")
    rows = rows.select("query_id", key, "_wanted", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+")).alias("_i", "_s"))
    rows = rows.withColumn("_hit", F.size(F.array_intersect(F.array_distinct(tokens("_s")), "_wanted")))
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", key).orderBy(F.desc("_hit"), "_i"))).where(F.col("_r") <= most)
    order = F.array_sort(F.collect_list(F.struct("_r", "_s")))
    content = best.groupBy("query_id", key).agg(F.array_join(F.transform(order, lambda x: x["_s"]), " ").alias("content"))
    return results.join(content, ["query_id", key], "left")


def retrieve(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, wide: int = 20, k: int = 5, key: str = "doc_id", text: str = "text", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, rank, content: the whole way from queries (query_id, query) to their best texts.

    Each query is cut into sub-queries, which ask for terms; the query's vector asks for neighbours; of the union the
    ``wide`` best are ranked anew by the product of their vectors with the query's, and the best ``k`` are brought
    down to the sentences that matter.
    """
    parts = queries.select("query_id", F.posexplode(sub_queries("query")).alias("_nth", "query"))
    asked = parts.select(F.struct("query_id", "_nth").alias("query_id"), "query")
    terms = bm25(docs, asked, wide, key=key, text=text).select(F.col("query_id.query_id").alias("query_id"), key, "score").groupBy("query_id", key).agg(F.max("score").alias("score"))
    near = vector_search(vectors, query_vectors, wide, "cosine", key, vector)
    found = hybrid(terms, near, wide, key)
    return compressed_for(rerank(found, vectors, query_vectors, k, key, vector), docs, queries, key, text)
