"""Documents to chunks: windows, sentences, paragraphs, tables, headings, parents; finishing and hierarchy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.core import col

SIZE, OVERLAP, LEAST, MOST, TABLE_ROWS = 1600, 200, 80, 3000, 25


def fixed_windows(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, most: int = MOST) -> DataFrame:
    """key, chunk_index, content: windows of ``size`` characters; a short tail joins the window before if it fits."""
    n, step = F.length(text), size - overlap
    last = F.greatest(F.ceil((n - overlap) / step).cast("int") - 1, F.lit(0))
    rows = df.where(n > 0).select(key, text, n.alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"), last.alias("_last"))
    begin = F.col("chunk_index") * step
    tail = F.col("_n") - F.col("_last") * step
    merges = (F.col("_last") > 0) & (tail < least) & ((F.col("_n") - (F.col("_last") - 1) * step) <= most)
    rows = rows.withColumns({"_tail": tail, "_merges": merges}).where(~(F.col("_merges") & (F.col("chunk_index") == F.col("_last"))))
    width = F.when(F.col("_merges") & (F.col("chunk_index") == F.col("_last") - 1), F.col("_n") - begin).otherwise(F.lit(size))
    return rows.select(key, "chunk_index", F.col(text).substr((begin + 1).cast("int"), width.cast("int")).alias("content"))


def breaks(sizes: np.ndarray, glue: int, size: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of parts that are joined: each as long as it fits into ``size`` with ``glue`` characters between parts.

    A run's end is looked up in the running sum of lengths, so the work goes by the chunks made, not by how the text grows.
    """
    upto = np.concatenate(([0], np.cumsum(sizes + glue)))
    first = 0
    while first < len(sizes):
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + size + glue, "right")) - 1)
        yield first, end
        first = end


def packed(df: DataFrame, keep: Sequence[str], parts: Column, glue: str, size: int) -> DataFrame:
    """keep, chunk_index, content: neighbouring parts joined while they fit into ``size`` characters; a longer part stands alone."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            sizes, ends = pc.utf8_length(lists.flatten()).to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            words, row, index, content, begin = lists.flatten().to_pylist(), [], [], [], 0
            for i, end in enumerate(ends.tolist()):
                for n, (a, b) in enumerate(breaks(sizes[begin:end].astype(np.int64), len(glue), size)):
                    row.append(i)
                    index.append(n)
                    content.append(glue.join(words[begin + a : begin + b]))
                begin = end
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keep))), pa.array(index, pa.int32()), pa.array(content, pa.string())], names=[*keep, "chunk_index", "content"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, parts.alias("_parts")).mapInArrow(join, f"{kinds}, chunk_index int, content string")


def _packed(df: DataFrame, key: str, text: str, pattern: str, glue: str, size: int) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")
    return packed(df, [key], parts, glue, size)


def sentence_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    return _packed(df, key, text, r"(?<=[.!?])\s+", " ", size)


def paragraph_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, pattern: str = r"\n{2,}") -> DataFrame:
    return _packed(df, key, text, pattern, "\n\n", size)


def question_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000) -> DataFrame:
    """Paragraphs of a document in chunks for questions: stripped of all blanks, joined by blank lines up to ``size`` characters."""
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n{2,}|\r\n{2,}"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return packed(df, [key], F.filter(parts, lambda x: x != ""), "\n\n", size)


def line_blocks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, position, block, is_heading: non-blank lines; a heading starts with a capital or digit and has 2 to 81 characters and 12 words at most."""
    rows = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("position", "block")).select(key, "position", F.trim("block").alias("block")).where("block != ''")
    heading = F.col("block").rlike(r"^[\p{Lu}0-9]") & F.length("block").between(2, 81) & (F.size(F.split("block", r"\s+")) <= 12)
    return rows.withColumn("is_heading", heading)


def structured_chunks(blocks: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """key, section, chunk_index, heading, content: a new section at each heading, its blocks packed up to ``size``; a block is in one chunk only."""
    w = Window.partitionBy(key).orderBy("position")
    rows = blocks.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w).cast("long"))
    body = F.array_sort(F.collect_list(F.struct("position", "block", "is_heading")))
    per = rows.groupBy(key, "section").agg(body.alias("_b"))  # as long as one document
    heading = F.when(F.element_at("_b", 1)["is_heading"], F.element_at("_b", 1)["block"])
    parts = F.transform(F.filter("_b", lambda b: ~b["is_heading"]), lambda b: b["block"])
    return packed(per.withColumn("heading", heading), [key, "section", "heading"], parts, "\n", size)


def table_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TABLE_ROWS) -> DataFrame:
    """Lines in groups of ``rows``, each under the table's first line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    base = df.select(key, lines.alias("_l")).where(F.size("_l") > 1)
    groups = F.sequence(F.lit(0), (F.ceil((F.size("_l") - 1) / rows) - 1).cast("int"))
    out = base.select(key, "_l", F.explode(groups).alias("chunk_index"))
    part = F.slice("_l", F.col("chunk_index") * rows + 2, rows)
    return out.select(key, "chunk_index", F.concat_ws("\n", F.element_at("_l", 1), F.array_join(part, "\n")).alias("content"))


def parents_and_children(df: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = "\n") -> DataFrame:
    """key, chunk_id, parent_id, content: of each section its first sentence as parent and the whole as child."""
    rows = df.select(key, F.posexplode(F.split(text, pattern)).alias("_i", "_s")).where(F.trim("_s") != "")
    own = F.concat_ws("_", F.col(key).cast("string"), F.col("_i").cast("string"))
    parent = rows.select(key, F.concat(own, F.lit("_p")).alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.element_at(F.split("_s", r"(?<=[.!?])\s+"), 1).alias("content"))
    return parent.unionByName(rows.select(key, F.concat(own, F.lit("_c")).alias("chunk_id"), F.concat(own, F.lit("_p")).alias("parent_id"), F.col("_s").alias("content")))


def finalize(chunks: DataFrame, key: str = "doc_id", index: str = "chunk_index", content: str = "content", most: int = MOST) -> DataFrame:
    """Chunks with blanks squeezed and repeats inside a document dropped, numbered anew; rejects carry a reason.

    Columns: key, chunk_index (null for rejects), content, content_hash, token_count, reject_reason.
    """
    text = F.trim(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"\s+", " "))
    rows = chunks.select(key, F.col(index).alias("_i"), text.alias("content")).withColumn("content_hash", F.sha2(F.lower("content"), 256))
    bad = F.when(F.col("content") == "", "empty").when(F.length("content") > most, "too long")
    seen = F.row_number().over(Window.partitionBy(key, "content_hash").orderBy("_i"))
    rows = rows.withColumn("reject_reason", F.coalesce(bad, F.when(seen > 1, "duplicate")))
    number = F.sum(F.col("reject_reason").isNull().cast("int")).over(Window.partitionBy(key).orderBy("_i")) - 1
    return rows.select(key, F.when(F.col("reject_reason").isNull(), number).cast("long").alias("chunk_index"), "content", "content_hash", token_estimate("content").alias("token_count"), "reject_reason")


def token_estimate(c: str | Column, model: str | None = None) -> Column:
    n = F.size(F.split(F.trim(col(c)), r"\s+"))
    n = F.floor(n * 1.3) if model and model.startswith("gpt") else n
    return F.greatest(n.cast("long"), F.lit(1))


def hierarchy(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, heading, section_id, blocks: sections in order of first appearance."""
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("heading", F.last(F.when(F.col("is_heading"), F.col("block")), True).over(w)).where("heading is not null")
    per = rows.groupBy(key, "heading").agg(F.min("position").alias("_p"), F.count(F.lit(1)).alias("blocks"))
    return per.select(key, "heading", F.row_number().over(Window.partitionBy(key).orderBy("_p")).cast("long").alias("section_id"), "blocks")


def automatic(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, strategy: table for texts of mostly delimited lines without headings, paragraph for blank-line texts, else structure."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    table = F.size(F.filter(lines, lambda x: x.contains("|"))) * 2 > F.size(lines)
    return df.select(key, F.when(table, "table").when(F.col(text).contains("\n\n"), "paragraph").otherwise("structure").alias("strategy"))


def split_ends(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of windows that end behind the last blank line, line end or space in them, each begun ``overlap`` before the last end.

    Cuts are looked for behind the overlap only, so that each window ends later than the one before.
    """
    begin = 0
    while begin < len(text):
        end = min(begin + size, len(text))
        if end < len(text):
            end = next((at + len(s) for s in ("\n\n", "\n", " ") if (at := text.rfind(s, begin + overlap + 1, end)) > 0), end)
        yield begin, end
        if end == len(text):
            return
        begin = end - overlap


def recursive_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 800, overlap: int = 100) -> DataFrame:
    """key, chunk_index, content: the stripped text in windows of split_ends(), stripped, empty ones left out and not numbered."""
    if not 0 <= overlap < size - 2:
        raise ValueError("the overlap is shorter than a window")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, index, content = [], [], []
            for i, whole in enumerate(batch.column(1).to_pylist()):
                whole = (whole or "").strip()
                made = [c for a, b in split_ends(whole, size, overlap) if (c := whole[a:b].strip())]
                row += [i] * len(made)
                index += range(len(made))
                content += made
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(index, pa.int64()), pa.array(content, pa.string())], names=[key, "chunk_index", "content"])

    return df.select(key, text).mapInArrow(cut, f"`{key}` {df.schema[key].dataType.simpleString()}, chunk_index long, content string")


def structure_or_windows(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """key, chunk_index, content: chunks by headings; a text that has none of them, nothing but headings, in windows."""
    made = structured_chunks(line_blocks(df, key, text), key, size)
    order = Window.partitionBy(key).orderBy("section", "chunk_index")
    first = made.select(key, (F.row_number().over(order) - 1).alias("chunk_index"), "content")
    return first.unionByName(fixed_windows(df, key, text, size).join(made.select(key).distinct(), key, "left_anti"))


def ingest(df: DataFrame, language: Column, kind: Column, filename: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """key, filename, language, document_type, chunk_count, chunks: the registry row of each text that gives a valid chunk.

    A chunk has its number, content, hash, token and character counts and the number of all chunks.
    """
    done = finalize(structure_or_windows(df, key, text, size), key).where("reject_reason is null")
    part = F.struct("chunk_index", "content", "content_hash", "token_count", F.length("content").alias("character_count"))
    per = done.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"), F.array_sort(F.collect_list(part)).alias("chunks"))
    return df.select(key, F.col(filename).alias("filename"), language.alias("language"), kind.alias("document_type")).join(per, key)
