"""Rules on texts, and verdicts on hosts from shrunken rates of rule failures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.kernels import SPACE, U, Words, blocks, column, mix, parts, range_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MAX_HOST_RATE = 0.5  #: a host whose shrunken failure rate is above this loses all its documents

ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
tri AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS t
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, len(w.words) AS n_words,
         coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (SELECT len(l) - len(list_distinct(l)) FROM (SELECT list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
r AS (
  SELECT source, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 20 * n_dup_lines > n_words, word_chars > 10 * n_words]) AS failed,
         unnest(['short', 'repeats', 'symbols', 'dup_lines', 'long_words']) AS rule
  FROM b WHERE source IS NOT NULL),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, count(*) FILTER (WHERE failed)::DOUBLE AS f FROM r GROUP BY source, rule),
p AS (SELECT rule, sum(f) / sum(n) AS mu, count(*) AS k, sum(n) AS t, sum(n * n) AS t2, sum(f * f / n) AS s FROM h GROUP BY rule),
v AS (SELECT rule, mu, (s - t * mu * mu - (k - 1) * mu * (1 - mu)) / nullif(t - t2 / t, 0) AS var FROM p),
q AS (SELECT rule, mu, CASE WHEN mu <= 0 OR mu >= 1 THEN 1e6 ELSE greatest(1, least(1e6, CASE WHEN var > 0 THEN mu * (1 - mu) / var - 1 ELSE 1e6 END)) END AS strength FROM v),
x AS (SELECT source, max((f + mu * strength) / (n + strength)) > 0.5 AS host_failed FROM h JOIN q USING (rule) GROUP BY source)
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM b LEFT JOIN x ON b.source = x.source
"""


def text_counts(raws: list[bytes]) -> list[np.ndarray]:
    """COUNTS of each text."""
    w = Words(raws, lower=False)
    docs = len(raws)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[w.doc_end] - total[w.doc_start]

    chars = per_text(~SPACE[w.data] & ((w.data & 0xC0) != 0x80))
    symbols = per_text(SYMBOLS[w.data])

    cut = np.union1d(np.flatnonzero(w.data == 10), w.doc_end - 1)
    begin = np.concatenate(([0], cut[:-1] + 1)) if docs else cut
    owner = np.searchsorted(w.doc_end, cut, "right")
    black = np.concatenate(([0], np.cumsum(~SPACE[w.data])))
    full = black[cut] > black[begin]
    owner, begin, cut = owner[full], begin[full], cut[full]
    lines = mix(range_hashes(w.data, begin, cut) + mix(U(1) + owner.astype(U)))
    first = np.unique(lines, return_index=True)[1]
    repeated = np.bincount(owner, minlength=docs) - np.bincount(owner[first], minlength=docs)

    covered = np.zeros(len(w.hash), bool)
    if len(w.hash) >= 3:
        doc = w.doc()
        a, b, c = w.hash[:-2], w.hash[1:-1], w.hash[2:]
        inside = doc[:-2] == doc[2:]
        three = mix(a + mix(b + mix(c + mix(U(1) + doc[:-2].astype(U)))))
        three[~inside] = mix(np.flatnonzero(~inside).astype(U) + U(1 << 60))
        order = np.argsort(three, kind="stable")
        same = three[order[1:]] == three[order[:-1]]
        twice = np.zeros(len(three), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for shift in range(3):
            covered[shift : shift + len(three)] |= twice
    words = np.concatenate(([0], np.cumsum(covered)))
    repeats = words[w.first + w.count] - words[w.first]
    return [w.count, chars, symbols, repeated, repeats]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and COUNTS of each whole text; a null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = column(batch, "text")
            for at, raws in blocks(texts):
                found = [pa.array(x.astype(np.int64)) for x in text_counts(raws)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raws)), batch.column(1).slice(at, len(raws)), *found], names=["doc_id", "host", *COUNTS])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(count, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


#: What a document fails by; a host's rate of each is judged by itself.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "20 * n_dup_lines > n_words",
    "long_words": "word_chars > 10 * n_words",
}


def host_rates(rows: DataFrame) -> DataFrame:
    """host, rule, n, failed, rate: each host's failures of each rule, rates drawn to the mean of all hosts.

    Each rule has a beta prior of its own, with the mean of all rows and a strength (its two parameters' sum) by the method
    of moments from the spread of the hosts' rates beyond chance, within 1 and 1e6. Rows without a host belong to none.
    """
    failures = [F.count_if(F.expr(when)).cast("double").alias(f"f_{rule}") for rule, when in RULES.items()]
    hosts = rows.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), *failures)
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"f_{rule}").alias("failed")) for rule in RULES])
    hosts = hosts.select("host", "n", F.inline(each))
    p = hosts.groupBy("rule").agg(
        (F.sum("failed") / F.sum("n")).alias("mu"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"),
        F.sum(F.col("n") * F.col("n")).alias("t2"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("s"),
    )
    var = F.expr("try_divide(s - t * mu * mu - (k - 1) * mu * (1 - mu), t - t2 / t)")
    strength = "case when mu <= 0 or mu >= 1 then 1e6 else greatest(1d, least(1e6, case when var > 0 then mu * (1 - mu) / var - 1 else 1e6 end)) end"
    p = p.select("rule", "mu", var.alias("var")).select("rule", "mu", F.expr(strength).cast("double").alias("strength"))
    rate = (F.col("failed") + F.col("mu") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(p), "rule").select("host", "rule", "n", "failed", rate.alias("rate"))


def quality_rules(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, COUNTS, base_failed, kept, host_rate, host_rule.

    base_failed: fewer than 50 words, or more than half of the words lie in a three-word window that the text has
    twice. Failures of each of RULES are added up by host and their rates shrunk with the rule's empirical beta prior; a host
    whose rate of any rule is above ``max_host_rate`` fails with all its documents. host_rate is its highest rate, host_rule that
    rule (of equal ones the last by name). Documents without a host are judged by the base rules alone. A null or empty text has
    no words and fails. Repeated rows count once each; null ids and other columns do no harm; an empty table gives an empty result.
    """
    rows = counts(docs, id_col, text_col, host_col)
    failed = F.expr(f"({RULES['short']}) or ({RULES['repeats']})")
    rows = materialize(rows.withColumn("base_failed", failed))
    worst = host_rates(rows).groupBy("host").agg(F.max(F.struct("rate", "rule")).alias("worst"))
    hosts = materialize(worst.select("host", F.col("worst.rate").alias("host_rate"), F.col("worst.rule").alias("host_rule")))
    out = rows.join(hosts, "host", "left")
    bad = F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), "host_rate", "host_rule")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("host_rate", "host_rule")
