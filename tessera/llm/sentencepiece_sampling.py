"""SentencePiece segmentations sampled from the piece lattice, and lossless decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.kernels import Rolling, U, blocks, column, list_column, mix, parts

SPACE_MARK = "▁"
_PARTS = re.compile(r"\n| [^ \n]*|[^ \n]+")
_tables: dict[tuple, Pieces] = {}


@dataclass
class Pieces:
    """Beginnings of a model's pieces by hash: id (-1 for none) and weight; bytes of every id; ids of single bytes."""

    hashes: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    widest: int
    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    byte_ids: np.ndarray
    byte_weight: float

    def __post_init__(self):
        self.shift = U(64 - max(4, len(self.hashes).bit_length() + 2))  # hashes are even, so few begin alike
        self.near = np.searchsorted(self.hashes, np.arange(1 << 64 - int(self.shift), dtype=U) << self.shift)
        self.padded = np.append(self.hashes, U((1 << 64) - 1))

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """As searchsorted() in the model's hashes, from the first that begins alike."""
        out = self.near.take((hashes >> self.shift).view(np.int64))
        rest = np.flatnonzero(self.padded.take(out) < hashes)
        while len(rest):
            out[rest] += 1
            rest = rest[self.padded[out[rest]] < hashes[rest]]
        return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hash_all(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(Rolling(codes).ranges(start, end) + (end - start).astype(U))


def load(model: bytes, alpha: float) -> Pieces:
    """Weights follow the pieces' order in the model: 1 / (10 + rank) ** alpha, scaled to a sum of one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    names = [sp.id_to_piece(i) for i in plain]
    order = np.argsort([-sp.get_score(i) for i in plain], kind="stable")
    weight = np.empty(len(plain))
    weight[order] = (10.0 + np.arange(len(plain))) ** -alpha
    sizes = np.array([len(x) for x in names])
    known = dict(zip(names, zip(plain, (weight / weight.sum()).tolist(), strict=True), strict=True))
    heads = sorted({x[:k] for x in names for k in range(1, len(x) + 1)})
    head_ends = np.cumsum([len(x) for x in heads])
    hashes = hash_all(codes_of("".join(heads)), head_ends - np.array([len(x) for x in heads]), head_ends)
    ids, shares = (np.array(v) for v in zip(*[known.get(x, (-1, 0.0)) for x in heads], strict=True))
    by = np.argsort(hashes)
    raw = [b""] * n
    for i, x in zip(plain, names, strict=True):
        raw[i] = x.replace(SPACE_MARK, " ").encode()
    byte_ids = np.zeros(256, np.int64)
    for i in range(n):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[3:5], 16)
            raw[i], byte_ids[value] = bytes([value]), i
    size = np.array([len(x) for x in raw])
    return Pieces(hashes[by], ids[by], shares[by], int(sizes.max()), np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, byte_ids, float(weight.min() / weight.sum()))


def words_of(text: str) -> list[str]:
    """Parts that start at each space and around each line end; a lattice does not reach over their ends."""
    if "\x00" in text:
        return _PARTS.findall(text)
    return [w for w in text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00") if w]


class Lattice:
    """The lattices of distinct words: nodes are ends of characters, edges the pieces that end there.

    Forward filtering gives each node the total weight of all ways to it; ``key`` holds, node by node, the running
    shares of the edges into it, so that one search per node and step samples a way back.
    """

    def __init__(self, words: list[str], p: Pieces):
        text = "".join(words)
        marked = codes_of(text.replace(" ", SPACE_MARK))
        literal = codes_of(text) == ord(SPACE_MARK)  # must come back as it is: bytes only
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        self.first = ends - sizes + np.arange(len(words))  # each word has one node more than characters
        owner, of_node = (np.repeat(np.arange(len(words)), n) for n in (sizes, sizes + 1))
        at = np.arange(len(marked))
        room = ends[owner] - at
        froms, tos, ids, weights = [], [], [], []
        bad = np.concatenate(([0], np.cumsum(literal)))
        roll = Rolling(marked)
        alive = at
        for width in range(1, min(p.widest, int(sizes.max(initial=0))) + 1):
            alive = alive[room[alive] >= width]
            h = mix(roll.ranges(alive, alive + width) + U(width))
            place = np.minimum(p.place(h), len(p.hashes) - 1)
            hit = (p.hashes[place] == h) & (bad[alive + width] == bad[alive])
            alive, place = alive[hit], place[hit]
            whole = p.ids[place] >= 0
            start, place = alive[whole], place[whole]
            froms.append(start + owner[start])
            tos.append(start + owner[start] + width)
            ids.append(p.ids[place])
            weights.append(p.weights[place])
        alone = np.ones(len(marked), bool)
        if ids:
            alone[(froms[0] - of_node[froms[0]])] = False
        lone = at[alone]  # a character that is no piece: its bytes
        froms.append(lone + owner[lone])
        tos.append(lone + owner[lone] + 1)
        ids.append(-1 - lone)
        weights.append(np.full(len(lone), p.byte_weight))
        f, t, i, w = map(np.concatenate, (froms, tos, ids, weights))
        nodes = len(marked) + len(words)
        step = t - self.first[of_node[t]]
        total = np.zeros(nodes)  # of all ways to a node, after division by the node's scale
        scale = np.zeros(nodes)  # as a logarithm, so that no word is too long
        total[self.first] = 1.0
        order = np.lexsort((f, t, step))
        f, t, i, w, step = f[order], t[order], i[order], w[order], step[order]
        share = np.zeros(len(t))
        into = np.flatnonzero(np.diff(t, prepend=-1))  # where the edges into a node begin
        cut = np.searchsorted(step, np.arange(1, int(step.max(initial=0)) + 2))
        node_cut = np.searchsorted(into, cut)
        for a, b, c, d in zip(cut[:-1], cut[1:], node_cut[:-1], node_cut[1:], strict=True):
            if a == b:
                continue
            to, from_ = t[into[c:d]], f[a:b]
            lead = np.repeat(scale[f[into[c:d]]], np.diff(np.append(into[c:d], b)))  # the scale of the first edge's start
            share[a:b] = total[from_] * w[a:b] * np.exp(scale[from_] - lead)
            sums = np.add.reduceat(share[a:b], into[c:d] - a)
            total[to], scale[to] = 1.0, scale[f[into[c:d]]] + np.log(sums)
            share[a:b] /= np.repeat(sums, np.diff(np.append(into[c:d], b)))
        order = np.argsort(t, kind="stable")
        f, t, i, share = f[order], t[order], i[order], share[order]
        begin = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=nodes))))
        run = np.cumsum(share)
        head = np.flatnonzero(np.diff(t, prepend=-1))
        run -= np.repeat(run[head] - share[head], np.diff(np.append(head, len(t))))
        run[np.append(head[1:], len(t)) - 1] = 1.0
        self.key, self.back, self.ids, self.last = np.append(t + run, np.inf), f, i, self.first + sizes
        self.begin = begin
        self.raw = text.encode("utf-8", "surrogatepass")
        lead = np.flatnonzero((np.frombuffer(self.raw, np.uint8) & 0xC0) != 0x80)
        self.char_begin = np.append(lead, len(self.raw))

    def sample(self, which: np.ndarray, seed: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words in order, and how many each word has; ``seed`` has a number for each word."""
        node, goal = self.last[which].copy(), self.first[which]
        live = np.flatnonzero(node > goal)
        picked, owner, nth = [], [], []
        turn = 0
        while len(live):
            u = (mix(seed[live] + U((turn + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U(11)).astype(float) * 2.0**-53
            at = node[live]
            u += at
            edge = self.begin[at]
            rest = np.flatnonzero(self.key.take(edge) <= u)
            while len(rest):
                edge[rest] += 1
                rest = rest[self.key[edge[rest]] <= u[rest]]
            edge = np.minimum(edge, self.begin[at + 1] - 1)  # a sum rounded up
            picked.append(edge)
            owner.append(live)
            nth.append(np.full(len(live), turn))
            node[live] = self.back[edge]
            live = live[node[live] > goal[live]]
            turn += 1
        if not picked:
            return np.zeros(0, np.int64), np.zeros(len(which), np.int64)
        edge, owner_, turn_ = map(np.concatenate, (picked, owner, nth))
        number = np.bincount(owner_, minlength=len(which))
        ordered = np.empty(len(edge), np.int64)
        ordered[np.cumsum(number)[owner_] - 1 - turn_] = self.ids[edge]
        plain = ordered >= 0
        if plain.all():
            return ordered, number
        char = np.where(plain, 0, -1 - ordered)
        wide = np.where(plain, 1, self.char_begin[char + 1] - self.char_begin[char])
        out = np.repeat(ordered, wide)
        fill = np.flatnonzero(out < 0)
        within = np.arange(len(out)) - np.repeat(np.cumsum(wide) - wide, wide)
        data = np.frombuffer(self.raw, np.uint8)
        out[fill] = p.byte_ids[data[self.char_begin[-1 - out[fill]] + within[fill]]]
        return out, np.bincount(np.repeat(np.arange(len(which)), number), wide, len(which)).astype(np.int64)


def decode_ids(ids: np.ndarray, p: Pieces) -> bytes:
    size = p.size[ids]
    shift = p.begin[ids] - np.cumsum(size) + size
    return p.data[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes()


def _pieces(model: bytes, alpha: float) -> Pieces:
    key = (hash(model), alpha)
    if key not in _tables:
        _tables.clear()
        _tables[key] = load(model, alpha)
    return _tables[key]


def model_bytes(path: str) -> bytes:
    """A model file on the driver; executors get it by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, alpha: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_crc32, lossless, and ids if ``keep_ids``.

    A text is cut before each space and around each line end; in every part, however long, a segmentation is drawn with probability in proportion to the
    product of its pieces' weights, by filtering the lattice forward and sampling it backward. Numbers come from
    (seed, doc_id, place in the text), so a row's ids don't depend on partitions or reruns; equal rows get equal ids.
    Characters that are no piece become bytes. No normalisation is done, and decode() gives the text back; ``lossless``
    says that it did for this row. A null or empty text has no ids. A null id counts as -1. Other columns are
    ignored; an empty table gives an empty result.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared.value, alpha)
        for batch in parts(batches):
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for at, raws in blocks(texts, 4 << 20):
                some = [t or "" for t in texts[at : at + len(raws)]]
                split = [words_of(t) if t else [] for t in some]
                size = np.fromiter(map(len, split), np.int64, len(split))
                said = list(chain.from_iterable(split))
                number = dict(zip(dict.fromkeys(said), count()))  # noqa: B905
                which = np.fromiter(map(number.__getitem__, said), np.int64, len(said))
                del said
                keys = np.array([(-1 if doc is None else doc) & (2**64 - 1) for doc in ids[at : at + len(raws)]], U)
                base = np.repeat(mix(keys + mix(np.array([seed], U))), size)
                place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                got, each = Lattice(list(number), p).sample(which, mix(base + place.astype(U)), p) if number else (which, which)
                ends = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(size)))]
                flat = [got[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                counts = np.diff(ends)
                sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in flat]
                same = [decode_ids(x, p) == raw for x, raw in zip(flat, raws, strict=True)]
                out = [pa.array(ids[at : at + len(raws)], pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same)]
                names = ["doc_id", "n_tokens", "ids_crc32", "lossless"]
                if keep_ids:
                    out.append(list_column(got.astype(np.int32), counts, pa.int32()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, lossless boolean" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows with piece ids; a null list gives a null text."""

    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared.value, 1.0)
        for batch in parts(batches):
            texts = [None if x is None else decode_ids(np.array(x, np.int64), p).decode("utf-8", "replace") for x in column(batch, "ids")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def default_model() -> bytes:
    import public_tokenizers

    return model_bytes(str(public_tokenizers.path("piece_bpe_32k.model")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_model())
