"""Phrases, language-model scores and the manifest against plain versions."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_scoring, merkle, phrases
from tessera.llm.kernels import Words

from . import brute
from .test_operators import SCHEMA, made_up

CLASHES = ("key", "pos", "n", "node", "item", "path", "root", "chunk", "word", "words", "at", "c", "p", "a", "learn", "rank")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def rows():
    langs, sources = ("en", "fr", None), ("s0", "é", None, "", "t")
    found = [(i if i % 9 else None, t, langs[i % 3], sources[i % 5] if i % 2 else "s0", i) for i, t in made_up()]
    return [*found, found[3], found[3], (5, "another text of five", "en", "s0", None), (999, "alone", "en", "lone", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest(docs, rows, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SIZE", 3**levels)
    plain = [(i, s, lang, n, t) for i, t, lang, s, n in rows]
    even = lambda i: i is not None and zlib.crc32(str(i).encode()) % 2 == 0
    want = brute.merkle(plain, lambda r: (*r[:4], r[4].replace("\n", "") if r[4] is not None and even(r[0]) else r[4]))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.manifest(docs, altered={"text": tampered})
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.before, s.after)), ""), 256)
    got = got.select("doc_id", "leaf", "subroot", "root", proof, merkle.fold(F.col("altered_leaf"), F.col("path"))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *w)) for r, w in zip(plain, want, strict=True))
    assert any(w[4] != w[2] for w in want) and any(w[4] == w[2] for w in want)


def test_manifest_fields_are_not_ambiguous(spark):
    rows = [(1, "ab", None, "s", 1), (2, None, "a", "s", 1), (3, "", "a", "s", 1), (4, "-", "a", "s", 1)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fields=("lang", "text")).collect()
    assert len({r["leaf"] for r in got}) == 4 and len({r["root"] for r in got}) == 1


@pytest.mark.parametrize(("budget", "few"), [(1, 0), (7, 500_000), (1 << 18, 3)])
def test_phrases(spark, docs, rows, monkeypatch, budget, few):
    monkeypatch.setattr(phrases, "BROADCAST_KEYS", few)
    monkeypatch.setattr(phrases, "LOCAL_WORDS", few)
    got = phrases.phrases(docs, least=3, top=40, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute.phrases([(r[2], r[1]) for r in rows], 3, 40)
    assert len(want) > 60 and sorted(map(tuple, got.collect())) == want


def test_phrases_of_random_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 300)
    rng = random.Random(5)
    texts = []
    for _ in range(80):
        words = rng.choices(["a", "B", "b", "cé", "d.e", "f", "\t", "g,", "!"], (9, 5, 3, 3, 2, 2, 1, 1, 1), k=60)
        texts.append((rng.choice(["x", None, "und", ""]), rng.choice((" ", "  ", "\t", " ")).join(words) + rng.choice(("\n", "", ";"))))
    got = phrases.phrases(spark.createDataFrame(texts, "lang string, text string").repartition(3), least=4, top=1000, budget=50)
    assert sorted(map(tuple, got.collect())) == brute.phrases(texts, 4, 1000)


def test_corpus_operators_on_empty_and_null_tables(spark):
    empty = clashing(spark.createDataFrame([], SCHEMA))
    assert merkle.manifest(empty).count() == 0 and phrases.phrases(empty).count() == 0
    assert lm_scoring.score_texts(empty.withColumn("learn", F.lit(True))).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert len({(r["leaf"], r["root"]) for r in merkle.manifest(nulls).collect()}) == 1
    assert phrases.phrases(nulls).count() == 0
    for learn in (True, False):
        got = lm_scoring.score_texts(nulls.withColumn("learn", F.lit(learn))).collect()
        assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(None, 1, int(learn), 3 * learn)] * 3


def spell(word, counts, m):
    """The probability of one word's spelling, bit by bit."""
    total, text = 0.0, word + b" "
    sets = len(lm_scoring.ORDERS)
    slots = np.concatenate([s for _, s, _ in lm_scoring.spelled([word])], axis=1)
    for i, byte in enumerate(text):
        for j in range(8):
            odds, longest = [], 0
            for o in range(sets):
                n0, n1 = (float(counts[b][slots[o][i][j]]) for b in (0, 1))
                odds.append(math.log((n1 + lm_scoring.SMALL) / (n0 + lm_scoring.SMALL)))
                longest = o + 1 if n0 + n1 else longest
            odds.append(1.0)
            mixed = (np.dot(m.by_order[longest], odds) + np.dot(m.by_place[j], odds)) / 2
            mixed = min(8.0, max(-8.0, mixed))
            cell = min(math.floor(mixed / 0.5) + 16, 31)
            part = mixed / 0.5 + 16 - cell
            one = (1 / (1 + math.exp(-mixed)) + m.refined[longest][cell] * (1 - part) + m.refined[longest][cell + 1] * part) / 2
            total += math.log10(one if byte >> (7 - j) & 1 else 1 - one)
    return total


@pytest.mark.parametrize("few", [False, True])
def test_scores_match_a_plain_model(spark, docs, rows, monkeypatch, few):
    if few:
        monkeypatch.setattr(lm_scoring, "CHUNK", 3000)
        monkeypatch.setattr(lm_scoring, "PLACES", 3)
        monkeypatch.setattr(lm_scoring, "TOKENS", 100)
    learned = docs.withColumn("learn", F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False)))
    got = lm_scoring.score_texts(learned)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes", "bits_per_byte", "train_tokens"]
    tokens = [[*brute.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")), ""] for r in rows]
    c = {}
    for r, t in zip(rows, tokens, strict=True):
        for w in t if r[0] is not None and r[0] % 3 else ():
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    words = spark.createDataFrame([(w.encode(),) for w in c], "word binary")
    counts = lm_scoring.slot_counts(words)
    m = lm_scoring.fit_mixer(words, v, spark.sparkContext.broadcast(lm_scoring.odds(counts)))
    spelling = {w: spell(w.encode(), counts, m) for t in tokens for w in set(t)}
    want = []
    for r, t in zip(rows, tokens, strict=True):
        base, score, before, took = 0.0, 0.0, {}, [0.0, 0.0, 0.0]
        for i, w in enumerate(t):
            own = c.get(w, 0)
            base += math.log10((own + 0.5) / (n + 0.5 * (v + 1)))
            alone = 10 ** spelling[w]
            corpus = max(own - 0.75, 0) / n + 0.75 * v / n * alone
            ways = [corpus, before.get(w, 0) / i if i else corpus, alone]
            shares = [(20 * s + x) / (20 + i) for s, x in zip((0.8, 0.15, 0.05), took, strict=True)]
            score += math.log10(sum(s * x for s, x in zip(shares, ways, strict=True)))
            joint = [s * x for s, x in zip((0.8, 0.15, 0.05), ways, strict=True)]
            took = [x + j / sum(joint) for x, j in zip(took, joint, strict=True)]
            before[w] = before.get(w, 0) + 1
        want.append((r[0], len(t), sum(w in c for w in t), n, base, score, sum(len(w.encode()) + 1 for w in t)))
    key = lambda x: (x[0] is None, x[0] or 0, x[4], x[5])
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["n_bytes"]) for r in got.collect()), key=key)
    for x, y in zip(found, sorted(want, key=key), strict=True):
        assert x[:4] == y[:4] and x[6] == y[6] and x[4] == pytest.approx(y[4]) and x[5] == pytest.approx(y[5], rel=1e-5)


def test_spellings_are_a_distribution():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcd", k=rng.randint(0, 3))).encode() for _ in range(200)]
    counts = np.zeros((2, 1 << lm_scoring.SLOT_BITS), np.float32)
    for _, slots, bit in lm_scoring.spelled(words):
        for o in range(len(lm_scoring.ORDERS)):
            np.add.at(counts[0], slots[o][bit == 0], 1)
            np.add.at(counts[1], slots[o][bit == 1], 1)
    table = lm_scoring.odds(counts)
    m = lm_scoring.learn(words, table)[0]
    first = [bytes([b]) for b in range(256)]  # the empty word and the first bytes of all others
    total = 0.0
    for b in first:
        word = [] if b == b" " else [b]
        _, slots, bit = next(lm_scoring.spelled(word or [b""]))
        inputs, longest = lm_scoring._inputs(table[0], slots[:, :1], None)
        both = lm_scoring._mixed(m, inputs, longest)[2].astype(float)
        low = np.minimum(np.floor(both / lm_scoring.STEP).astype(int) + lm_scoring.CELLS // 2, lm_scoring.CELLS - 2)
        part = both / lm_scoring.STEP + lm_scoring.CELLS // 2 - low
        one = (1 / (1 + np.exp(-both)) + m.refined[longest, low] * (1 - part) + m.refined[longest, low + 1] * part) / 2
        total += np.where(bit[:1] > 0, one, 1 - one).prod()
    assert total == pytest.approx(1)


def test_known_text_scores_above_noise(spark):
    rng = random.Random(3)
    stock = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(stock, k=80)), True) for i in range(60)]
    rows += [(100, " ".join(rng.choices(stock, k=80)), False), (101, " ".join("".join(rng.choices("zqxjkv", k=6)) for _ in range(80)), False)]
    rows += [(102, " ".join("".join(rng.choices("etaoinshr", k=6)) for _ in range(80)), False)]
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string, learn boolean")).collect()}
    assert got[100]["bits_per_byte"] < got[102]["bits_per_byte"] < got[101]["bits_per_byte"]


def test_chunks_number_every_word(spark):
    raws = [b"One two one", b"", b"two  three\n"]
    w = Words(raws)
    assert w.count.tolist() == [3, 0, 2]
    df = spark.createDataFrame([(i, True, r.decode()) for i, r in enumerate(raws)], "doc_id long, learn boolean, text string").coalesce(1)
    got = {bytes(x): n for r in lm_scoring.chunks(df).collect() for x, n in zip(r["words"], r["times"], strict=True)}
    assert got == {b"": 3, b"one": 2, b"two": 2, b"three": 1}
