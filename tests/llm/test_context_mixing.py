"""Scores of whole texts by mixed bit predictors against a plain version."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import context_mixing as cm
from tessera.llm import lm_scoring
from tessera.llm.queries import QUERIES

from . import brute

FULL = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 31) * 0x7FB5D329728EA185 & FULL
    x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D & FULL
    return x ^ x >> 33


def tokens(text):
    return [*brute.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), ""]


def spelled(text):
    """(byte, slots by context and bit) of a text's bytes."""
    data = b"".join(w.encode() + b" " for w in tokens(text))
    for at, byte in enumerate(data):
        before = (b" " * 6 + data)[at : at + 6]
        contexts = [before[-n:] for n in cm.ORDERS] + [before.rsplit(b" ", 1)[-1]]
        slots = []
        for i, c in enumerate(contexts):
            whole = int.from_bytes(c[::-1].rjust(8, b"\0"), "big")  # the last byte stands highest
            hashed = mixed((whole + (i + 1) * 0x9E3779B97F4A7C15 + len(c) * 0xD6E8FEB86659FD93) & FULL)
            rows = [(hashed + k * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 % (1 << 64) >> 68 - cm.SLOT_BITS for k in (0, 16 | byte >> 4)]
            half = byte >> 4, byte & 15
            slots.append([16 * rows[j // 4] + (1 << j % 4 | half[j // 4] >> 4 - j % 4) for j in range(8)])
        yield byte, slots


def plain_score(text, counts, m):
    total = 0.0
    for byte, slots in spelled(text):
        for j in range(8):
            odds, longest = [], 0
            for i in range(cm.CONTEXTS):
                n0, n1 = (float(counts[b].get(slots[i][j], 0)) for b in (0, 1))
                odds.append(max(-8.0, min(8.0, math.log((n1 + lm_scoring.SMALL) / (n0 + lm_scoring.SMALL)))))
                longest = i + 1 if n0 + n1 else longest
            odds.append(1.0)
            both = min(8.0, max(-8.0, (np.dot(m.by_order[longest], odds) + np.dot(m.by_place[j], odds)) / 2))
            cell = min(math.floor(both / 0.5) + 16, 31)
            part = both / 0.5 + 16 - cell
            one = (1 / (1 + math.exp(-both)) + m.refined[longest][cell] * (1 - part) + m.refined[longest][cell + 1] * part) / 2
            total += math.log10(one if byte >> (7 - j) & 1 else 1 - one)
    return total


@pytest.mark.parametrize("few", [False, True])
def test_scores_match_plain_bits(spark, monkeypatch, few):
    if few:
        monkeypatch.setattr(lm_scoring, "CHUNK", 300)
        monkeypatch.setattr(lm_scoring, "PLACES", 3)
    rng = random.Random(4)
    words = ["One", "two", "één", "a", "internationally", "internationalist", "\x00x", " ", "."]
    rows = [(i, rng.choice((" ", "\n", " \t")).join(rng.choices(words, k=rng.randint(1, 12))), i % 3 != 0) for i in range(40)]
    rows += [(40, None, True), (41, "", False), (41, "  ", True), (None, "a One", True), (None, "a one", None), (3, rows[3][1], True)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, learn boolean, words string").coalesce(2)
    got = cm.context_scores(docs)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes", "bits_per_byte", "train_tokens"]
    counts, c = ({}, {}), {}
    for _, text, learn in rows:
        for byte, slots in spelled(text) if learn else ():
            for by_bit in slots:
                for j, s in enumerate(by_bit):
                    into = counts[byte >> 7 - j & 1]
                    into[s] = into.get(s, 0) + 1
        for w in tokens(text) if learn else ():
            c[w] = c.get(w, 0) + 1
    held = lm_scoring.materialize(lm_scoring.chunks(lm_scoring.chosen(docs, "learn", "doc_id", "text")))
    found = cm.context_counts(held)
    for b in (0, 1):
        assert {int(s): int(found[b][s]) for s in np.flatnonzero(found[b])} == counts[b]
    table = spark.sparkContext.broadcast(np.clip(lm_scoring.odds(found), -8, 8))
    m = cm.fit_contexts(held, table)
    n, v, want = sum(c.values()), len(c), []
    for i, text, _ in rows:
        t = tokens(text)
        base = sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want.append((i, len(t), sum(w in c for w in t), n, sum(len(w.encode()) + 1 for w in t), base, plain_score(text, counts, m)))
    key = lambda x: (x[0] is None, x[0] or 0, x[5])
    rows = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["n_bytes"], r["base_score"], r["score"]) for r in got.collect()), key=key)
    for x, y in zip(rows, sorted(want, key=key), strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5]) and x[6] == pytest.approx(y[6], rel=1e-4)


def test_next_bytes_are_a_distribution():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 9))).encode() for _ in range(30)]
    piece = cm.runs_of_bytes(cm.spell_out([b"", *words]), np.array([*rng.choices(range(1, 31), k=200), 0], np.int32), np.array([201]))
    keys, times = cm.distinct_runs([piece])
    seen = np.zeros(2 << cm.SLOT_BITS, np.int64)
    cm.count_runs(keys, times, seen)
    odds, m = np.clip(lm_scoring.odds(seen.reshape(2, -1).astype(np.float32)), -8, 8), lm_scoring.Mixer.fresh(cm.CONTEXTS)
    cm.learn_runs(keys, times, odds, m, np.zeros((2, cm.CONTEXTS + 1, lm_scoring.CELLS)))
    for before in (int.from_bytes(b" " * 6, "little"), int(keys[50]) & (1 << 48) - 1, int.from_bytes(b"zz~\x00\xff ", "little")):
        follow = np.array([b << 48 | before for b in range(256)], np.uint64)
        assert (10 ** cm.run_scores(follow, odds, m)).sum() == pytest.approx(1)


def test_pieces_and_lots_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "be", "sea", "internationally", "é"], k=rng.randint(0, 9))) for _ in range(700)]
    docs = spark.createDataFrame([(i, i % 4 > 0, t) for i, t in enumerate(texts)], "doc_id long, learn boolean, text string").coalesce(1)
    batch = lm_scoring.chunks(docs).toArrow().to_batches()[0]
    found = []
    for piece, texts, lot in ((1 << 20, 256, 1 << 14), (100, 256, 50), (1 << 20, 5, 7)):
        for name, x in (("PIECE", piece), ("TEXTS", texts), ("LOT", lot)):
            monkeypatch.setattr(cm, name, x)
        seen = np.zeros(2 << cm.SLOT_BITS, np.int64)
        for _, some in cm.pieces(batch, True):
            cm.count_runs(*cm.distinct_runs(some()), seen)
        odds, m = lm_scoring.odds(seen.reshape(2, -1).astype(np.float32)), lm_scoring.Mixer.fresh(cm.CONTEXTS)
        found.append((seen, np.concatenate([cm.text_sums(some, odds, m) for _, some in cm.pieces(batch, False)])))
    for seen, scores in found[1:]:
        assert (seen == found[0][0]).all() and scores == pytest.approx(found[0][1]) and len(scores) == 700


def test_score_of_the_query_knows_what_words_follow_each_other(spark, tmp_path):
    rng = random.Random(8)
    stock = ["".join(rng.choices("etaoinshr", k=rng.randint(3, 8))) for _ in range(120)]
    follows = {w: stock[(7 * i + 1) % len(stock)] for i, w in enumerate(stock)}

    def said(n):
        words = [rng.choice(stock)]
        while len(words) < n:
            words.append(follows[words[-1]])
        return words

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:20]
    rows, plain = [], [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    for i in plain:
        rows.append((i, " ".join(said(40))))
    for a, b in zip(held[::2], held[1::2], strict=True):
        words = said(40)
        rows += [(a, " ".join(words)), (b, " ".join(rng.sample(words, len(words))))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op12_lm_scoring"](spark, str(tmp_path)).collect()}
    for a, b in zip(held[::2], held[1::2], strict=True):
        assert got[a]["held_out"] and got[a]["base_score"] == pytest.approx(got[b]["base_score"])
        assert got[a]["score"] > 0.8 * got[b]["score"]


def test_scores_without_rows_or_training(spark):
    kind = "doc_id long, text string"
    empty = spark.createDataFrame([], kind).withColumn("learn", F.lit(True))
    assert cm.context_scores(empty).count() == 0
    docs = spark.createDataFrame([(1, "one two"), (None, None)], kind).withColumn("learn", F.lit(False))
    got = {r["doc_id"]: r for r in cm.context_scores(docs).collect()}
    assert [(got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["bits_per_byte"]) for i in (1, None)] == [(3, 0, 0, pytest.approx(8)), (1, 0, 0, pytest.approx(8))]


def test_runs_of_a_chunk_are_laid_out_twice_at_most(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["a", "be", "sea", "internationally", "é"], k=rng.randint(0, 9))) for _ in range(600)]
    docs = spark.createDataFrame([(i, i % 4 > 0, t) for i, t in enumerate(texts)], "doc_id long, learn boolean, text string").coalesce(1)
    batch = lm_scoring.chunks(docs).toArrow().to_batches()[0]
    (want, times), whole = (cm.distinct_runs(next(cm.pieces(batch, yes))[1]()) for yes in (True, False))
    laid, lay = [], cm.runs_of_bytes
    monkeypatch.setattr(cm, "runs_of_bytes", lambda spelled, tokens, sizes: laid.append(len(sizes)) or lay(spelled, tokens, sizes))
    monkeypatch.setattr(cm, "SORTED", 500)
    found = cm.with_runs(batch)
    ((keys, n),) = cm.learned_runs(found)
    shown = cm.numbers(found["run_keys"][0].as_py(), found["runs"][0].as_py(), np.uint64)
    assert (keys == want).all() and (n == times).all() and (shown == whole[0]).all()
    seen = np.zeros(2 << cm.SLOT_BITS, np.int64)
    cm.count_runs(keys, n, seen)
    odds, m = lm_scoring.odds(seen.reshape(2, -1).astype(np.float32)), lm_scoring.Mixer.fresh(cm.CONTEXTS)
    cm.learn_runs(keys, n, odds, m, np.zeros((2, cm.CONTEXTS + 1, lm_scoring.CELLS)))
    assert len(cm.text_sums(next(cm.pieces(found, False))[1], odds, m, shown)) == 600
    assert sum(laid) == 2 * 600


def test_places_of_keys_that_share_hashes():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 56, 5000, np.uint64))
    places = cm.Places(keys)
    order = np.random.default_rng(4).integers(0, len(keys), 20000)
    assert len(places.tables) > 1 and (places.find(keys[order]) == order).all()
    assert len(cm.Places(keys[:0]).find(keys[:0])) == 0
