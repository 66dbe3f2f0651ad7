"""Packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.kernels import column, parts

#: Distinct segments whose ids a worker remembers; beyond that it forgets all and starts again.
CACHE = 600_000
#: Those that it keeps from one task to the next: the first ones it met, which tend to be the common ones.
HELD = 100_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

NEVER = 1 << 30  #: rank of a pair that is not merged

_UNSAFE = re.compile(r"[\W_](?:[.,]|(?<=\s)\s)")
_loaded: dict[int, SegmentTokenizer] = {}


def one_word(segment: str) -> bool:
    """A space or none, then letters of scripts whose blocks are long settled: the pattern leaves it whole."""
    letters = segment[1:] if segment[:1] == " " else segment
    return letters.isalpha() and (letters.isascii() or max(letters) < "\u0530")


class _Numbers(dict):
    """Numbers segments as they come; new ones are listed."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        number = self[segment] = len(self)
        self.new.append(segment)
        return number


class Merges:
    """Byte-pair merges of many words at once: in each round every word makes its first merge of lowest rank."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as they are
        hidden = [b for b in range(256) if b not in shown]
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_ids = np.array([vocab[names[b]] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.rank = np.append(key[order], np.iinfo(np.int64).max), np.append(order, NEVER)
        self.made = np.append(np.array([vocab[a + b] for a, b in pairs], np.int64)[order], 0)
        two = np.arange(1 << 16)
        self.first = self.ranks(self.byte_ids[two >> 8], self.byte_ids[two & 255])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, none of them empty, one after the other, and how many each has."""
        raws = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(raws)), np.fromiter(map(len, raws), np.int64, len(raws)))
        ids = self.byte_ids[data]
        rank = np.full(len(ids), NEVER)
        rank[:-1] = np.where(word[1:] == word[:-1], self.first[data[:-1] << 8 | data[1:]], NEVER)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            head = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), head)
            open_ = (best >> 32) < NEVER
            if not open_.all():
                rest = np.repeat(open_, np.diff(np.append(head, len(ids))))
                done.append((word[~rest], ids[~rest]))
                best = (best[open_] & 0xFFFFFFFF) - np.cumsum(~rest)[best[open_] & 0xFFFFFFFF]
                word, ids, rank = word[rest], ids[rest], rank[rest]
            else:
                best &= 0xFFFFFFFF
            if not len(ids):
                break
            ids[best] = self.made[np.searchsorted(self.keys, ids[best] << 32 | ids[best + 1])]
            keep = np.ones(len(ids), bool)
            keep[best + 1] = False
            best -= np.arange(len(best))  # one id fewer for each word before
            word, ids, rank = word[keep], ids[keep], rank[keep]
            for at in (best, best[best > 0] - 1):
                at = at[at + 1 < len(ids)]
                rank[at] = np.where(word[at] == word[at + 1], self.ranks(ids[at], ids[at + 1]), NEVER)
            rank[-1] = NEVER
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(word, minlength=len(words))


class SegmentTokenizer:
    """Ids of whole texts, made from the remembered ids of their segments.

    A byte-level tokenizer first splits a text by a fixed pattern, which looks at nothing before a split. In texts
    without two white spaces in a row, without a full stop or comma after anything but a letter or digit, and without
    white space at either end, the pattern splits before every space, full stop and comma and on both sides of every
    line end. So such a text may be cut there, and the ids of the parts, one after the other, are those of the
    text. Other texts, those with the string of an added token, and all texts of a tokenizer that splits
    otherwise, are encoded whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        made = json.loads(definition)
        split = made.get("pre_tokenizer") or {}
        self.cuts = not made.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        model = made["model"]
        odd = model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        self.merges = Merges(model) if self.cuts and model.get("type") == "BPE" and not odd else None
        self.forget()

    def forget(self) -> None:
        self.index = _Numbers()
        self.known = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def trim(self, keep: int) -> None:
        if self.known <= keep:
            return
        index = _Numbers()
        index.update(islice(self.index.items(), keep))
        self.index, self.known = index, keep
        self.used = int(self.begin[keep - 1] + self.size[keep - 1])
        self.flat, self.begin, self.size = self.flat[: self.used].copy(), self.begin[:keep].copy(), self.size[:keep].copy()

    def ids_of(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, one after the other, and how many each has.

        Those that the pattern leaves whole, a space or none and letters, are merged by Merges, others by the tokenizer.
        """
        word = np.fromiter((self.merges is not None and one_word(x) for x in segments), bool, len(segments))
        words, others = ([segments[i] for i in np.flatnonzero(w)] for w in (word, ~word))
        flat, size = [], np.zeros(len(segments), np.int64)
        for at in range(0, len(words), 50_000):
            ids, number = self.merges.encode(words[at : at + 50_000])
            flat.append(ids)
            size[np.flatnonzero(word)[at : at + 50_000]] = number
        ids = [e.ids for at in range(0, len(others), 10_000) for e in self.tokenizer.encode_batch_fast(others[at : at + 10_000], add_special_tokens=False)]
        size[~word] = np.fromiter(map(len, ids), np.int64, len(ids))
        flat.append(np.fromiter((x for one in ids for x in one), np.uint32))
        owner = np.concatenate((np.repeat(np.flatnonzero(word), size[word]), np.repeat(np.flatnonzero(~word), size[~word])))
        return np.concatenate(flat)[np.argsort(owner, kind="stable")], size

    def learn(self) -> None:
        """Encode the new segments."""
        new, self.index.new = self.index.new, []
        flat, sizes = self.ids_of(new)
        at = self.known
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while at + len(new) > len(self.begin):
            self.begin, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + len(new)] = sizes
        self.used += len(flat)
        self.known += len(new)

    def plain(self, text: str) -> bool:
        whole = not self.cuts or "\x00" in text or text[:1].isspace() or text[-1:].isspace() or text[:1] in (".", ",")
        return not (whole or _UNSAFE.search(text) or self.added and self.added.search(text))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if len(self.index) > CACHE:
            self.forget()
        number = self.index.__getitem__
        which: list[np.ndarray | None] = []
        for text in texts:
            if self.plain(text):
                parts = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").replace(",", "\x00,").replace(".", "\x00.").split("\x00")
                which.append(np.fromiter(map(number, parts), np.int64, len(parts)))
            else:
                which.append(None)
        if self.index.new:
            self.learn()
        for text, mine in zip(texts, which, strict=True):
            if mine is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            size = self.size[mine]
            shift = self.begin[mine] - np.cumsum(size) + size
            yield self.flat[np.repeat(shift, size) + np.arange(int(size.sum()))]


def _tokenizer(definition: Broadcast) -> SegmentTokenizer:
    key = hash(definition.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = SegmentTokenizer(definition.value)
    return _loaded[key]


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, ids_crc32, doc_tokens. A null text is empty."""
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # the vocabulary file, of fixed size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(definition)
        for batch in parts(batches):
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            ends = np.cumsum([len(t or "") for t in texts])
            at = 0
            while at < len(texts):  # about 4 million characters at once
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (4 << 20), "right")))
                rows: list[tuple] = []
                for i, one in enumerate(tok.encode([t or "" for t in texts[at:stop]])):
                    one = np.append(one, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(one), capacity):
                        part = one[start : start + capacity]
                        rows.append((ids[at + i], start, len(part), zlib.crc32(part.tobytes()), len(one)))
                at = stop
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        tok.trim(HELD)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first, each into the first bin that still has room.

    The room left in the bins is held in a tournament tree: each inner node has the larger room of its two children,
    so the first bin with enough room is found on one way down from the root.
    """
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left > right else right
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 0, group_pieces: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document: its ids, then ``end_id``, cut at multiples of ``capacity``.

    Result, one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Equal pieces are
    numbered, and all are dealt by a hash of what they are and that number to groups of about ``group_pieces``, however
    long a document is and however often a row or a null id is repeated. Each group is packed by itself, first fit
    decreasing. Ties in length go by doc_id, start and checksum, so the result, sequence_id too, depends on the rows
    alone. A null or empty text is the end id only; null ids and repeated rows are packed like any other row; an empty
    table gives an empty result; other columns are ignored. Sequences hold no gaps; padding is at their ends.
    """
    pieces = materialize(token_pieces(docs, tokenizer_json, capacity, end_id, id_col, text_col))
    groups = max(1, -(-pieces.count() // group_pieces))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        full = int((rows["length"] == capacity).sum())
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy()[full:], capacity)
        rows["offset"] = np.concatenate((np.zeros(full, np.int64), offsets))
        rows["sequence_id"] = (int(key[0]) << 32) + np.concatenate((np.arange(full), full + bins))
        return rows.drop(columns="g")

    numbered = pieces.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select(*names, F.explode(F.sequence(F.lit(1), "n")).alias("nth"))
    dealt = numbered.select(*names, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "nth"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInPandas(group, f"{PIECES}, offset long, sequence_id long").select(*names, "sequence_id", "offset")


def tokenizer_definition(path: str) -> str:
    """The text of a tokenizer file on the driver; executors get it by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_tokenizer() -> str:
    import public_tokenizers

    return tokenizer_definition(public_tokenizers.path("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
