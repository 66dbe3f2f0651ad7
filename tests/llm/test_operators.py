import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, language_id, line_dedup, minhash, packing, quality_classifier, quality_rules, sentencepiece_sampling, suffix_dedup, toxicity

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made_up(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeats, odd white space and characters of several bytes."""
    rng = random.Random(seed)
    stock = ["".join(rng.choices("abcdefghé😀ñ", k=rng.randint(1, 8))) for _ in range(300)]
    say = lambda k: " ".join(rng.choices(stock, k=k))
    passage = say(40)
    texts = [None, "", " \t\n", "one", "One", "two words", "Two  words\n", "!!! ###", "a" * 400, "ab " * 300, "x\x00y z", " lead", "tail ", "a \n b\n\n  c"]
    while len(texts) < n:
        kind = rng.randrange(6)
        if kind == 0 and len(texts) > 20:
            texts.append(rng.choice(texts[15:]))
        elif kind == 1 and len(texts) > 20:
            w = rng.choice(texts[15:]).split(" ")
            w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(f"{say(30)} {passage}\n{say(20)}")
        elif kind == 3:
            line = say(12)
            texts.append("\n".join([line, say(5), line, "", line]))
        else:
            texts.append(say(rng.randint(3, 200)))
    texts.append(" ".join(stock[i % 300] for i in range(60_000)))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 4}" if i % 7 else None, 0) for i, t in made_up()]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


OPERATORS = {
    "language_id": lambda d: language_id.predict(d, language_id.fit(d)),
    "suffix_dedup": suffix_dedup.suffix_dedup,
    "quality_rules": quality_rules.quality_rules,
    "quality_classifier": lambda d: quality_classifier.quality(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))),
    "exact_dedup": exact_dedup.exact_dedup,
    "packing": lambda d: packing.pack(d, packing.default_tokenizer()),
    "toxicity": lambda d: toxicity.toxicity(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))),
    "minhash": minhash.near_dedup,
    "line_dedup": line_dedup.line_dedup,
    "sentencepiece": lambda d: sentencepiece_sampling.encode(d, sentencepiece_sampling.default_model()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(spark, name):
    rows = [(1, "same text here", "en", "s", 1), (1, "same text here", "en", "s", 1), (None, None, None, None, None), (None, "same text here", None, None, None), (2, "", "fr", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for extra in ("doc", "h", "row", "score", "rep", "kept", "set", "key", "norm", "found", "y", "id"):
        df = df.withColumn(extra, F.lit("clash"))
    got = OPERATORS[name](df).collect()
    assert len(got) == 5
    assert sum(r["doc_id"] is None for r in got) == 2


def test_exact_dedup(docs):
    want = brute.exact(made_up())
    for i, r in by_id(exact_dedup.exact_dedup(docs)).items():
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[i]
        assert r["kept"] == (want[i][0] == i)


def test_suffix_dedup(docs):
    want = brute.suffix(made_up())
    got = by_id(suffix_dedup.suffix_dedup(docs))
    for i, r in got.items():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[i]
        assert r["n_spans"] == len(r["spans"]) and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("length", (3, 20, 32, 200, 300, 4000))
def test_suffix_dedup_of_other_lengths(spark, length):
    rng = random.Random(length)
    say = lambda k: "".join(rng.choices("abcd", k=k))
    shared = say(2 * length)
    texts = [(0, "ab" * 500), (1, say(50) + shared + say(9)), (2, shared[length // 2 :] + say(70)), (3, "b" + "ab" * 300), (4, say(length - 1)), (5, "xy" * 3000), (6, None), (7, "yx" * 2500 + shared)]
    want = brute.suffix(texts, length)
    got = by_id(suffix_dedup.suffix_dedup(spark.createDataFrame(texts, "doc_id long, text string"), length))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


def test_suffix_dedup_rejects_lengths_it_cannot_pack(spark):
    for length in (0, 2, 4001):
        with pytest.raises(ValueError):
            suffix_dedup.suffix_dedup(spark.createDataFrame([], SCHEMA), length)


def test_suffix_dedup_of_one_id_with_two_texts(spark):
    rng = random.Random(2)
    a, b, c = ("".join(rng.choices("abcdefgh", k=400)) for _ in range(3))
    rows = [(1, a), (1, b), (None, c), (None, b), (2, a + "x"), (3, c), (4, c), (4, c)]
    got = [(r["doc_id"], r["kept_text"]) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (1, b), (None, c), (None, b), (2, a + "x"), (3, c), (4, ""), (4, "")], key=repr)


def test_suffix_dedup_spreads_large_buckets(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", -1)
    monkeypatch.setattr(common, "BROADCAST_KEYS", -1)
    want = brute.suffix(made_up())
    assert {i: r["kept_sha256"] for i, r in by_id(suffix_dedup.suffix_dedup(docs)).items()} == {i: w[3] for i, w in want.items()}


def test_suffix_dedup_in_small_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    raw = [b"ab" * 3000, bytes(random.Random(3).choices(range(97, 123), k=5000)), b"x" * 99]
    seen = [(i, o, len(d)) for w, offs, d, _ in suffix_dedup._stretches(raw, 100) for i, o in zip(w, offs, strict=True)]
    assert {i for i, *_ in seen} == {0, 1} and max(o for *_, o in [(i, o) for i, o, _ in seen]) == 5600


def test_near_dedup(docs):
    for k in (4, 5):
        want = brute.near(made_up(), k, 80)
        for i, r in by_id(minhash.near_dedup(docs, k=k)).items():
            assert (r["n_shingles"], r["component_id"]) == want[i]
            assert r["kept"] == (want[i][1] == i)


@pytest.mark.parametrize("light", (0, 2, 10**6))
def test_near_dedup_of_a_group_of_edited_copies(spark, monkeypatch, light):
    """Copies of one text with few and many edits: the centre of a bucket is linked with some of them only."""
    monkeypatch.setattr(minhash, "LIGHT", light)
    monkeypatch.setattr(minhash, "BLOCK", 500)
    monkeypatch.setattr(minhash, "CELLS", 300)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(60), rng.choice((0, 1, 1, 2, 2, 3, 4))):
            w[at] = f"e{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    got = by_id(minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in got.items()} == {i: w[1] for i, w in brute.near(rows, 5, 80).items()}


def test_near_dedup_of_one_id_with_two_texts(spark):
    rng = random.Random(3)
    make = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))
    a, b, c = make(), make(), make()
    rows = [(5, a), (5, b), (3, b + " x"), (9, a), (7, c), (None, c), (None, b)]
    for order in (rows, rows[::-1]):
        got = minhash.near_dedup(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3)]
        assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)


def test_near_dedup_chain_of_links(spark):
    """Each text is near the next but not the one after, so components need more than a bucket's first centre."""
    rng = random.Random(5)
    w = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    rows = [(i, " ".join(w[i * 6 : i * 6 + 100]), None, None, 0) for i in range(40)]
    got = by_id(minhash.near_dedup(spark.createDataFrame(rows, SCHEMA)))
    want = brute.near([(r[0], r[1]) for r in rows], 5, 80)
    assert {i: r["component_id"] for i, r in got.items()} == {i: w[1] for i, w in want.items()}


@pytest.mark.parametrize("one_task", (-1, 10**6))
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "ONE_TASK_EDGES", one_task)
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 150: 100, 200: 100}


def thue_morse(n, a, b):
    """The string and its complement: sums of letters times powers of an odd base can't tell them apart."""
    one = "".join((a, b)[i.bit_count() & 1] for i in range(n))
    return one, one.translate(str.maketrans(a + b, b + a))


@pytest.mark.parametrize("n", [256, 512, 1024, 2048])
def test_regular_strings_are_told_apart(spark, n):
    one, two = thue_morse(n, "a", "b")
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_dedup(df, k=4).collect()} == {1: 1, 2: 2}
    lines = spark.createDataFrame([(1, f"{one}\n{two}\n{one}", "s")], "doc_id long, text string, source string")
    assert quality_rules.quality_rules(lines).first()["n_dup_lines"] == 1
    assert [r["n_linked"] for r in line_dedup.line_dedup(df).collect()] == [0, 0]
    assert [r["n_removed"] for r in suffix_dedup.suffix_dedup(df, length=n).collect()] == [0, 0]
    want = brute.suffix([(1, one), (2, two)], 100)
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(df).collect()} == {i: w[1] for i, w in want.items()}


def test_quality_rules(docs):
    got = by_id(quality_rules.quality_rules(docs))
    for i, t in made_up()[:-1]:
        r = got[i]
        want = brute.rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_hosts_lose_all_or_nothing(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad", None, "junk.example", 0) for i in range(90)] + [(100 + i, good, None, "junk.example", 0) for i in range(5)]
    rows += [(200 + i, good, None, "fine.example", 0) for i in range(50)] + [(300, "bad", None, "fine.example", 0), (400, good, None, None, 0)]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)))
    assert {i for i, r in got.items() if r["kept"]} == {*range(200, 250), 400}


def test_a_host_fails_by_one_rule(spark):
    plain = " ".join(f"word{i}" for i in range(60))
    symbols = " ".join(f"word{i} #" for i in range(60))
    lines = "\n".join(["same line of words here"] * 2 + [f"alpha{i} beta{i} gamma{i} delta{i}" for i in range(20)] + ["same line of words here"] * 6)
    rows = [(i, symbols, None, "marks.example", 0) for i in range(80)] + [(90 + i, plain, None, "marks.example", 0) for i in range(9)]
    rows += [(200 + i, plain, None, "fine.example", 0) for i in range(70)] + [(300 + i, symbols, None, "fine.example", 0) for i in range(9)]
    rows += [(400 + i, lines, None, "lines.example", 0) for i in range(70)] + [(500, symbols, None, None, 0), (501, plain, None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = by_id(quality_rules.quality_rules(df))
    assert not any(r["base_failed"] for i, r in got.items())
    assert {r["host_rule"] for i, r in got.items() if i < 100} == {"symbols"} and {r["host_rule"] for i, r in got.items() if 400 <= i < 500} == {"dup_lines"}
    assert {i for i, r in got.items() if r["kept"]} == {*range(200, 270), *range(300, 309), 500, 501}
    import duckdb

    documents = df.toPandas()  # noqa: F841
    want = duckdb.sql(quality_rules.ORACLE).fetchall()
    assert sorted(want) == sorted(tuple(r)[:8] for r in got.values())
    rates = {(r["host"], r["rule"]): r["rate"] for r in quality_rules.host_rates(quality_rules.counts(df)).collect()}
    assert len(rates) == 15 and rates["marks.example", "symbols"] > 0.8 and rates["marks.example", "short"] == 0


def test_packing(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(packing.default_tokenizer())
    texts = [*made_up(), (900, "an <|endoftext|> inside"), (901, "a  b  c"), (902, "it's  we'll 12 345\r\n x")]
    df = docs.sparkSession.createDataFrame(texts, "doc_id long, text string")
    pieces = [r.asDict() for r in packing.pack(df, packing.default_tokenizer()).collect()]
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts}
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[p["doc_id"]])) == (p["length"], p["ids_crc32"], p["doc_tokens"])
    bins = {}
    for p in pieces:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= sum(p["length"] for p in pieces) / 1024 * 1.05 + 1


def test_merges_give_the_tokenizers_ids():
    rng = random.Random(13)
    tok = packing.SegmentTokenizer(packing.default_tokenizer())
    odd = ["".join(rng.choices("aeiothnr\u00e9\u00f1\u00df\u0436\u03bb", k=rng.randint(1, 25))) for _ in range(3000)]
    odd += ["a" * k for k in range(1, 80)] + [" " + "ab" * k for k in range(1, 50)] + ["", " ", ",", "it's", " 12", "a1b", "\u4e2d\u6587", "x\u00b2", "\n"]
    assert sum(map(packing.one_word, odd)) == len(odd) - 9
    flat, size = tok.ids_of(odd)
    ends = np.cumsum(size)
    for text, end, n in zip(odd, ends.tolist(), size.tolist(), strict=True):
        assert flat[end - n : end].tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_of_repeated_rows_does_not_depend_on_partitions(spark):
    rows = [(None, "same text of no id")] * 300 + [(7, "again and again")] * 300 + [(i, "w" + "x y " * i) for i in range(200)] + [(7, "another text of seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [sorted(packing.pack(d, packing.default_tokenizer(), capacity=64, group_pieces=100).collect(), key=repr) for d in (df, df.repartition(7))]
    assert out[0] == out[1]
    groups = {}
    for r in out[0]:
        groups.setdefault(r["sequence_id"] >> 32, []).append(r)
    assert len(groups) > 5 and max(map(len, groups.values())) < 250
    assert sum(r["doc_id"] is None for r in out[0]) == 300


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 333):
        sizes = rng.integers(1, 100, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], np.zeros(n, int)
        for i in np.argsort(-sizes, kind="stable"):
            for b, r in enumerate([*room, 100]):
                if r >= sizes[i]:
                    break
            if b == len(room):
                room.append(100)
            want[i] = b
            assert offsets[i] == 100 - room[b]
            room[b] -= sizes[i]
        assert (bins == want).all()


def test_suffix_automaton_gives_longest_matches():
    rng = random.Random(4)
    text = [rng.randrange(1, 4) for _ in range(200)]
    steps = language_id.suffix_automaton(text)
    have = {tuple(text[i:j]) for i in range(200) for j in range(i + 1, min(200, i + 12) + 1)}
    for _ in range(500):
        query = [rng.randrange(1, 4) for _ in range(11)]
        state, n = 0, 0
        while n < len(query) and query[n] in steps[state]:
            state, n = steps[state][query[n]], n + 1
        assert all((tuple(query[:k]) in have) == (k <= n) for k in range(1, 12))


def plain_phrases(codes, known):
    """Number of longest phrases of ``codes`` that occur in ``known``, from left to right; both are strings."""
    count = at = 0
    while at < len(codes):
        n = 1
        while at + n < len(codes) and codes[at : at + n + 1] in known:
            n += 1
        at += n
        count += 1
    return count


def check_phrases(parser, model, texts):
    lower = language_id.letters()
    show = lambda t: "".join(map(chr, parser.codes_of(lower[np.frombuffer(t.encode("utf-32-le"), np.uint32)]).tolist()))
    phrases, number = parser.phrases(texts)
    assert phrases.tolist() == [[plain_phrases(show(t), show(sample)) for t in texts] for sample in model.samples]
    assert number.tolist() == [sum(c.isalpha() for c in t) for t in texts]


@pytest.mark.parametrize("lane", (3, 64, 512, 10**6))
def test_language_phrases_match_a_plain_parse(monkeypatch, lane):
    monkeypatch.setattr(language_id, "LANE", lane)
    rng = random.Random(lane)
    model = language_id.LanguageModel(("a", "b", "c"), ("the cat sat on the mat " * 3, "der hund sass auf der matte", "ab" * 900 + "ba" * 5), (0.4, 0.3, 0.3))
    texts = ["The hat; the mat!", "auf der katze", "", "zzz 123", "the cat sat on the matte " * 60, "ab" * 1500 + "c" + "ba" * 700, "".join(rng.choices("abcdest ", k=4000))]
    check_phrases(language_id.Parser(model), model, texts)
    check_phrases(language_id.Parser(model, 0), model, texts)


def test_language_phrases_of_more_than_a_thousand_letters():
    rng = random.Random(5)
    one, two = [chr(c) for c in range(0x4E00, 0x4E00 + 900)], [chr(c) for c in range(0x4E00 + 700, 0x4E00 + 1700)]
    make = lambda own, k: "".join(rng.choices(own, k=k))
    model = language_id.LanguageModel(("a", "b", "c"), (make(one, 3000) + "".join(one), make(two, 3000), "the cat sat on the mat"), (0.4, 0.4, 0.2))
    texts = [model.samples[0][40:90] + make(two, 40) + "the hat", make(one, 700), "\u732b the \u93cf cat", "", model.samples[1][:600]]
    parser, full = language_id.Parser(model, 0), language_id.Parser(model)
    assert not parser.full and full.full and len(np.unique(parser.code)) > 1000
    check_phrases(parser, model, texts)
    check_phrases(full, model, texts)


def test_language_of_texts_in_large_alphabets(spark):
    rng = random.Random(6)
    spans = {"x": range(0x4E00, 0x4E00 + 1200), "y": range(0xAC00, 0xAC00 + 800), "z": range(97, 123)}
    words = {lang: ["".join(chr(rng.choice(r)) for _ in range(3)) for _ in range(500)] for lang, r in spans.items()}
    rows = [(i, " ".join(rng.choices(words["xyz"[i % 3]], k=40)), "xyz"[i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language_id.predict(df, language_id.fit(df.where("doc_id < 90"))))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    few = language_id.fit(df, sample_texts=2)
    assert [len(x) for x in few.samples] == [319, 319, 319]  # two whole texts of each language
    assert [len(x) for x in language_id.fit(df, sample_chars=10).samples] == [159, 159, 159]  # only longer ones


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(6)
    n, t = 700, 40
    dense = rng.random((n, t)) * (rng.random((n, t)) < 0.1)
    dense[:, 0] += 0.01
    dense /= np.sqrt((dense**2).sum(axis=1, keepdims=True))
    row, term = np.nonzero(dense)
    e = toxicity.Examples(np.arange(n), np.zeros(n, np.float32), row, term, dense[row, term].astype(np.float32), np.ones(t), 0.1)
    index = toxicity.BlockMaxIndex(e)
    for _ in range(30):
        q = np.sort(rng.choice(t, 5, replace=False))
        w = rng.random(5).astype(np.float32)
        w /= np.sqrt(w @ w)
        rows, sims = index.nearest(q, w, 15)
        full = dense[:, q] @ w
        want = np.sort(full)[::-1][:15]
        want = want[want > 0]
        assert np.allclose(sims, want, atol=1e-5)
        assert np.allclose(full[rows], sims, atol=1e-5)


def test_toxicity_finds_marked_texts(spark):
    rng = random.Random(8)
    stock = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(stock, k=60) + (["vile", "Rotten!"] if i % 5 == 0 else [])), i % 5 == 0) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i < 400], "doc_id long, y int")
    got = by_id(toxicity.toxicity(df, labels))
    assert all((got[i]["score"] >= 0.5) == y for i, _, y in rows if i >= 400)
    assert all(e % 5 == 0 for e in got[500]["evidence"])


def test_nearest_examples_are_exact_over_postings_and_matrix():
    rng = np.random.default_rng(7)
    n, t = 1500, 300
    dense = (rng.random((n, t)) * (rng.random((n, t)) < 0.05)).astype(np.float32)
    dense[:, 0] += 0.01
    dense /= np.sqrt((dense**2).sum(axis=1, keepdims=True))
    row, term = np.nonzero(dense)
    e = toxicity.Examples(np.arange(n), np.zeros(n, np.float32), row, term, dense[row, term], np.ones(t), 0.1)
    full = dense @ dense.T
    np.fill_diagonal(full, -1)
    for width in (0, 20, 300):
        q, rows, sims = toxicity.BlockMaxIndex(e, width).search(row, term, dense[row, term], n, 15, np.arange(n))
        assert np.bincount(q, minlength=n).tolist() == np.minimum((full > 0).sum(axis=1), 15).tolist()
        assert np.allclose(full[q, rows], sims, atol=1e-5)
        assert all(np.allclose(sims[q == i], np.sort(full[i])[::-1][: (q == i).sum()], atol=1e-5) for i in range(0, n, 50))


def test_every_word_of_toxicity_examples_counts(spark):
    rows = [(i, f"plain{i % 7} common{i % 5} word{i}", 0) for i in range(60)] + [(60 + i, f"common{i % 5} rare{i}", 1) for i in range(3)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100, "rare1 elsewhere"), (101, "word7"), (102, "unseen")], "doc_id long, text string")
    got = by_id(toxicity.toxicity(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, y int")))
    assert got[100]["evidence"][0] == 61  # a word of one toxic text
    assert got[101]["evidence"][0] == 7  # clean neighbours vote too
    assert got[100]["score"] > got[101]["score"]
    assert all(len(got[i]["evidence"]) == 5 for i in range(60))


def test_quality_classifier_on_held_out_rows(spark):
    rng = random.Random(9)
    stock = [f"w{i}" for i in range(200)]
    make = lambda good: " ".join(rng.choices(stock, k=80)) if good else " ".join(x + "***" for x in rng.choices(stock, k=80))
    rows = [(i, make(i % 3 > 0), int(i % 3 > 0)) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = by_id(quality_classifier.quality(df, spark.createDataFrame([(i, y) for i, _, y in rows if i < 400], "doc_id long, y int")))
    right = [(got[i]["score"] >= 0.5) == y for i, _, y in rows if i >= 400]
    assert np.mean(right) > 0.97


def test_word_vector_sums_match_a_plain_count(spark):
    texts = ["a b a, c", "b", None, "c c c"]
    got = {r["bucket"]: list(r[1:]) for r in quality_classifier.context_sums(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    index = quality_classifier.index_vectors()
    want = {}
    for t in texts:
        _, w = quality_classifier.words([(t or "").encode()])
        for x, y in zip(w[:-1], w[1:], strict=True):
            for p, q in ((x, y), (y, x)):
                want[p] = want.get(p, 0) + index[q]
    assert got == {int(b): v.tolist() for b, v in want.items() if v.any()}


def test_sentencepiece_round_trip_and_seeds(spark, docs):
    model = sentencepiece_sampling.default_model()
    extra = spark.createDataFrame([(900, "\u2581 literal  \u2581"), (901, "tab\tand\r\n\x00 zero"), (902, "\U0001f600" * 70)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    got = sentencepiece_sampling.encode(rows, model)
    texts = {r["doc_id"]: r["text"] for r in sentencepiece_sampling.decode(got, model).collect()}
    assert texts == {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    assert all(r["lossless"] for r in got.collect())
    again = {r["doc_id"]: r["ids"] for r in sentencepiece_sampling.encode(rows.repartition(7), model).collect()}
    assert again == {r["doc_id"]: r["ids"] for r in got.collect()}
    other = {r["doc_id"]: r["ids"] for r in sentencepiece_sampling.encode(rows, model, seed=2).collect()}
    assert other != again


def test_sampled_segmentations_follow_the_weights():
    import collections
    import itertools

    p = sentencepiece_sampling.load(sentencepiece_sampling.default_model(), 0.3)
    weight = dict(zip(p.ids[p.ids >= 0].tolist(), p.weights[p.ids >= 0].tolist(), strict=True))
    raw = {i: p.data[p.begin[i] : p.begin[i] + p.size[i]].tobytes() for i in weight}
    by_text = {v: k for k, v in raw.items()}
    want = {}
    for cuts in itertools.product((0, 1), repeat=3):
        at = [0, *[i + 1 for i in range(3) if cuts[i]], 4]
        ids = [by_text.get(b" the"[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        if None not in ids:
            want[tuple(ids)] = float(np.prod([weight[i] for i in ids]))
    n = 40_000
    lattice = sentencepiece_sampling.Lattice([" the"], p)
    ids, number = lattice.sample(np.zeros(n, int), sentencepiece_sampling.mix(np.arange(n, dtype=np.uint64)), p)
    ends = np.concatenate(([0], np.cumsum(number)))
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True))
    for k, w in want.items():
        assert abs(seen[k] / n - w / sum(want.values())) < 0.01


def test_lattices_of_long_words_are_whole():
    """Shares of all pieces of a word of 700 characters, against plain forward and backward sums."""
    import collections

    p = sentencepiece_sampling.load(sentencepiece_sampling.default_model(), 0.5)
    ids = p.ids[p.ids >= 0].tolist()
    weight = {p.data[p.begin[i] : p.begin[i] + p.size[i]].tobytes().decode(): w for i, w in zip(ids, p.weights[p.ids >= 0].tolist(), strict=True)}
    word = "internationalisation" * 35
    ends = [[k for k in range(1, min(17, len(word) - at + 1)) if word[at : at + k] in weight] for at in range(len(word))]
    up, down = [0.0] * (len(word) + 1), [0.0] * len(word) + [1.0]
    up[0], scale = 1.0, 4.5  # keeps the sums in range
    for at, sizes in enumerate(ends):
        for k in sizes:
            up[at + k] += up[at] * weight[word[at : at + k]] * scale**k
    for at in range(len(word) - 1, -1, -1):
        down[at] = sum(weight[word[at : at + k]] * scale**k * down[at + k] for k in ends[at])
    n = 3000
    got, number = sentencepiece_sampling.Lattice([word], p).sample(np.zeros(n, int), sentencepiece_sampling.mix(np.arange(n, dtype=np.uint64)), p)
    seen, size = collections.Counter(), p.size.tolist()
    for row in np.split(got, np.cumsum(number)[:-1]):
        at = 0
        for i in row.tolist():
            seen[at, size[i]] += 1
            at += size[i]
        assert at == len(word)
    for at in (0, 40, 46, 47, 48, 95, 333, 690):
        for k in ends[at]:
            share = up[at] * weight[word[at : at + k]] * scale**k * down[at + k] / down[0]
            assert abs(seen[at, k] / n - share) < 0.045
    assert sentencepiece_sampling.words_of("a\x00b  c\n\nd") == ["a\x00b", " ", " c", "\n", "\n", "d"]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("xyz\u00e9"))
        elif kind == 1:
            out.pop(at)
        else:
            out[at] = rng.choice("xyz\u00e9")
    return "".join(out)


def test_banded_edits():
    rng = random.Random(11)
    for _ in range(3000):
        a = "".join(rng.choices("ab", k=rng.randint(1, 12)))
        b = edited(rng, a + "aaaa", rng.randint(0, 4))
        for e in range(4):
            assert line_dedup.within(a, b, e) == (edit_distance(a, b) <= e)


def plain_line_dedup(texts, edits, per_edit):
    """{id: (kept text, linked lines, class id)} of [(id, text)] with distinct ids."""
    blank = lambda x: not x.strip(" \t\r\x0b\x0c")
    places = [(i, n, x) for i, t in texts for n, x in enumerate(y for y in (t or "").split("\n") if not blank(y))]
    distinct = sorted({x for *_, x in places})
    top = {x: x for x in distinct}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    linked = set()
    for n, a in enumerate(distinct):
        for b in distinct[:n]:
            may = min(edits, min(len(a), len(b)) // per_edit)
            if may and abs(len(a) - len(b)) <= may and edit_distance(a, b) <= may:
                top[root(a)] = root(b)
                linked |= {a, b}
    first = {}
    for i, n, x in sorted(places):
        first.setdefault(root(x), (i, n))
    out = {}
    for i, t in texts:
        kept, n, own = [], 0, []
        for x in (t or "").split("\n"):
            if blank(x):
                kept.append(x)
            else:
                own.append(x)
                if first[root(x)] == (i, n):
                    kept.append(x)
                n += 1
        out[i] = "\n".join(kept), sum(x in linked for x in own), min([first[root(x)][0] for x in own] + [i])
    return out


@pytest.mark.parametrize(("edits", "per_edit", "low", "high"), [(2, 5, 3, 60), (2, 5, 18, 24), (2, 1, 1, 9), (3, 4, 3, 30)])
def test_line_dedup(spark, edits, per_edit, low, high):
    rng = random.Random(12)
    stock = ["".join(rng.choices("abcdef ", k=rng.randint(low, high))) for _ in range(40)]
    texts = [(i, "\n".join([*(edited(rng, rng.choice(stock), rng.choice((0, 0, 1, 1, 2, 3)) if rng.random() < 0.7 else 0) for _ in range(rng.randint(0, 6))), *rng.choices(["", "short", "Short"], k=2)])) for i in range(50)]
    want = plain_line_dedup(texts, edits, per_edit)
    got = by_id(line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string"), edits, per_edit))
    assert {i: (r["kept_text"], r["n_linked"], r["class_id"]) for i, r in got.items()} == want
    assert sum(r["n_removed"] for r in got.values()) > 50


@pytest.mark.parametrize("light", (0, 8, 10**6))
def test_line_dedup_of_one_line_edited_many_times(spark, monkeypatch, light):
    """Lines that share segments with a centre and are not all within the edits of it."""
    monkeypatch.setattr(line_dedup, "LIGHT", light)
    monkeypatch.setattr(line_dedup, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(line_dedup, "CELLS", 300)
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", -1)
    rng = random.Random(14)
    base = "".join(rng.choices("abcdefghij ", k=60))
    texts = [(i, edited(rng, base, rng.choice((1, 2, 3, 4, 5, 6)))) for i in range(150)]
    want = plain_line_dedup(texts, 2, 5)
    got = by_id(line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {i: (r["kept_text"], r["n_linked"], r["class_id"]) for i, r in got.items()} == want
    assert len({r["class_id"] for r in got.values()}) > 10


def test_line_dedup_of_one_id_with_two_texts(spark):
    a, b = "the first line of it\nanother line that is long", "a third line\nthe first line of it"
    df = spark.createDataFrame([(5, a), (5, b), (5, a), (None, "only once here"), (None, "and this one too"), (6, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["n_removed"], r["kept_text"]) for r in line_dedup.line_dedup(df).collect()]
    assert sorted(x for x in got if x[0] is None) == [(None, 0, "and this one too"), (None, 0, "only once here")]
    kept = {t for i, _, t in got if i == 5}
    assert len(kept) == 2 and sum("the first line of it" in t for t in kept) == 1 and len([i for i, *_ in got if i == 5]) == 3


def test_pieces_are_found_without_a_search_of_the_whole_model():
    p = sentencepiece_sampling.load(sentencepiece_sampling.default_model(), 1.0)
    rng = np.random.default_rng(5)
    asked = np.concatenate((p.hashes, p.hashes + np.uint64(1), rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2), np.array([0, (1 << 64) - 1], np.uint64)))
    assert (p.place(asked) == np.searchsorted(p.hashes, asked)).all()
    words = [" the", " segmentations", "猫▁x"]
    lattice = sentencepiece_sampling.Lattice(words, p)
    which = rng.integers(0, 3, 2000)
    ids, number = lattice.sample(which, rng.integers(0, 1 << 63, 2000, np.uint64), p)
    assert sentencepiece_sampling.decode_ids(ids, p) == "".join(words[i] for i in which).encode() and (number > 0).all()
