"""A manifest of a dataset: Merkle trees of three children over the rows of each source, and one over the sources.

Rows are numbered within their source and cut into aligned blocks of 3 ** LEVELS leaves. A block keeps each of its levels
as one string of concatenated hex digests: a parent is the digest of a fixed-width substring, and the substrings on both
sides of a node are its siblings. The blocks' roots are the leaves of the next stage, until one is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, numbered, table

ARITY = 3
HEX = 64  #: characters of a digest
LEVELS = 5  #: levels in a block
SIZE = ARITY**LEVELS
RUN = ARITY * HEX
PATH = "array<struct<before:string,after:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value; so no two lists of values look alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _depth(n: Column) -> Column:
    """Levels above the nodes of a block of a tree with ``n`` nodes: all, or as many as lead to one node."""
    depth = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        depth = F.when(n <= ARITY**k, F.lit(k)).otherwise(depth)
    return depth


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda j: F.sha2(F.substring(level, j * RUN + 1, F.lit(RUN)), 256)), "")


def _siblings(levels: Column, depth: Column, place: Column) -> Column:
    """(before, after) of the node above ``place`` (in its block) on each level."""

    def flanks(level: Column, height: Column) -> Column:
        node = F.floor(place / F.pow(F.lit(float(ARITY)), height)).cast("int")
        run, at = F.floor(node / ARITY).cast("int") * RUN, node % ARITY
        after = F.substring(level, run + (at + 1) * HEX + 1, (ARITY - 1 - at) * HEX)
        return F.struct(F.substring(level, run + 1, at * HEX).alias("before"), after.alias("after"))

    return F.transform(F.slice(levels, F.lit(1), depth), flanks).cast(PATH)


def _block(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (key, pos, n of the key, node, item): their nodes in order, the levels' strings and the root."""
    nodes = nodes.withColumn("block", F.floor(F.col("pos") / SIZE))
    blocks = nodes.groupBy("key", "n", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "item"))).alias("nodes"))
    blocks = blocks.withColumn("depth", _depth(F.col("n")))
    bottom = F.array(F.array_join(F.transform("nodes", lambda x: x.node), "")).cast("array<string>")
    heights = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), F.col("depth"))
    levels = F.aggregate(heights, bottom, lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))).cast("array<string>"))
    return materialize(blocks.withColumn("levels", levels).withColumn("root", F.element_at("levels", -1)))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Stages of blocks from nodes (key, pos, n, node, item) up to one block for each key."""
    stages = [_block(nodes)]
    while not stages[-1].where(F.col("n") > SIZE).isEmpty():
        up = stages[-1].select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / SIZE).alias("n"), F.col("root").alias("node"), F.lit(None).cast("boolean").alias("item"))
        stages.append(_block(up))
    return stages


def descend(stages: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """(node, item, path, *carried) of the lowest nodes; ``above`` has key, path and carried columns, ``path`` what follows the key's root."""
    rows = above.withColumn("pos", F.lit(0).cast("long"))
    for stage in reversed(stages):
        here = stage.select("key", F.col("block").alias("pos"), "nodes", "levels", "depth").join(rows, ["key", "pos"])
        own = F.transform("nodes", lambda x: F.struct(x.pos.alias("pos"), x.node.alias("node"), x.item.alias("item"), _siblings(F.col("levels"), F.col("depth"), (x.pos % SIZE).cast("int")).alias("own")))
        rows = here.select("key", "path", *carried, F.inline(own))
        rows = rows.select("key", "pos", "node", "item", *carried, F.concat("own", "path").alias("path"))
    return rows.drop("key", "pos")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s.before, node, s.after), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", altered: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, path, and altered_leaf.

    A leaf is the SHA-256 of the fields, each as ``-`` for null or its UTF-8 byte count, ``:`` and value. Within a source
    (null is one of its own) leaves stand by id, null first, rows of one id by their leaf; runs of three become their
    digest until one is left, the subroot. Subroots stand by source, null first, and lead to the root in the same way.
    ``path`` has the siblings before and after the row's node for each level up to the root. altered_leaf is the leaf
    of the row with the columns of ``altered`` in the place of its own (the leaf, if none is given).

    A null or empty text is told from the other by its field. Equal rows have equal leaves, each with its own path.
    Other columns are ignored, whatever their names; an empty table gives an empty result. A source that holds a third of
    all rows is many blocks; no task sees more than a range of it.
    """
    value = {c: F.col(c) for c in fields}
    leaf = digest([value[c] for c in fields])
    other = digest([(altered or {}).get(c, value[c]) for c in fields]) if altered else leaf
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), leaf.alias("node"), other.alias("other"))
    rows = materialize(rows.withColumn("key", field(F.col("source"))))
    rows = numbered(rows, "key", ["doc_id", "node"], count="n")
    stages = climb(rows.select("key", "pos", "n", "node", F.struct("doc_id", F.when(F.col("other") != F.col("node"), F.col("other")).alias("other"), "source").alias("item")))
    tops = stages[-1].select("key", F.col("root").alias("node"), _source(F.col("key")).alias("source"))
    tops = numbered(tops.withColumn("all", F.lit("all")), "all", ["source"], count="n")
    upper = climb(tops.select(F.col("all").alias("key"), "pos", "n", "node", F.struct("key").alias("item")))
    no_path = F.array().cast(PATH)
    sources = descend(upper, upper[-1].select("key", no_path.alias("path"), "root"), ["root"])
    sources = materialize(sources.select(F.col("item.key").alias("key"), F.col("node").alias("subroot"), "root", "path"))
    rows = descend(stages, sources, ["subroot", "root"])
    return rows.select("item.doc_id", F.col("node").alias("leaf"), "subroot", "root", "path", F.coalesce("item.other", "node").alias("altered_leaf"))


def _source(key: Column) -> Column:
    """The source that field() made ``key`` of."""
    return F.when(key != "-", F.expr("substring(key, instr(key, ':') + 1)"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(table(spark, sf_dir, "documents"), altered={"text": tampered})
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.before, s.after)), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("altered_leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


_LEAF = " || ".join(_sql_field(c) for c in FIELDS[:-1])
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT)"""

ORACLE = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source, sha256({_LEAF} || {_sql_field("text")}) AS leaf,
         sha256({_LEAF} || {_sql_field("replace(text, chr(10), '')")}) AS changed,
         coalesce({_CRC} % 2 = 0, false) AS even
  FROM documents),
n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS c
  FROM leaf),
t AS (
  SELECT source, 0 AS lvl, i, c, leaf AS h FROM n
  UNION ALL
  SELECT source, lvl + 1, i // 3, (c + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE c > 1 GROUP BY source, lvl, i // 3, c),
s AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS c
  FROM t WHERE c = 1),
u AS (
  SELECT 0 AS lvl, i, c, subroot AS h FROM s
  UNION ALL
  SELECT lvl + 1, i // 3, (c + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE c > 1 GROUP BY lvl, i // 3, c),
steps AS (
  SELECT n.source, n.i AS place, t.lvl,
         coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i < n.i // (3 ** t.lvl)::BIGINT), '') AS l,
         coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i > n.i // (3 ** t.lvl)::BIGINT), '') AS r
  FROM n JOIN t ON t.source IS NOT DISTINCT FROM n.source AND t.c > 1 AND t.i // 3 = n.i // (3 ** (t.lvl + 1))::BIGINT
  GROUP BY n.source, n.i, t.lvl),
above AS (
  SELECT s.source, u.lvl,
         coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i < s.i // (3 ** u.lvl)::BIGINT), '') AS l,
         coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i > s.i // (3 ** u.lvl)::BIGINT), '') AS r
  FROM s JOIN u ON u.c > 1 AND u.i // 3 = s.i // (3 ** (u.lvl + 1))::BIGINT
  GROUP BY s.source, u.lvl),
p1 AS (SELECT source, place, list({{'l': l, 'h': '', 'r': r}} ORDER BY lvl) AS path FROM steps GROUP BY source, place),
p2 AS (SELECT source, list({{'l': l, 'h': '', 'r': r}} ORDER BY lvl) AS path FROM above GROUP BY source),
x AS (
  SELECT n.doc_id, n.leaf, CASE WHEN even THEN changed ELSE leaf END AS start, s.subroot, (SELECT h FROM u WHERE c = 1) AS root,
         list_concat(coalesce(p1.path, []), coalesce(p2.path, [])) AS path
  FROM n JOIN s ON s.source IS NOT DISTINCT FROM n.source
  LEFT JOIN p1 ON p1.source IS NOT DISTINCT FROM n.source AND p1.place = n.i
  LEFT JOIN p2 ON p2.source IS NOT DISTINCT FROM n.source),
f AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda e: e.l || e.r), '')) AS proof_sha256,
         list_reduce(list_prepend({{'l': '', 'h': start, 'r': ''}}, path),
           lambda a, e: {{'l': '', 'h': sha256(e.l || a.h || e.r), 'r': ''}}).h AS folded_root
  FROM x)
SELECT *, folded_root = root AS verified FROM f
"""
