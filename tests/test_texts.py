import random
import re

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import chunking as ch
from tessera.operators import documents as do
from tessera.operators import memory as me
from tessera.operators import retrieval as re_
from tessera.operators import vectors as ve
from tessera.plans import texts

TEXTS = ["", "short", "One. Two! Three? " * 40, "Heading\nbody text here.\n\nMore of it.\nHead Two\n" + "x" * 300, "a|b\n" + "\n".join(f"{i}|{i}" for i in range(60))]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def chunks(df):
    out = {}
    for r in df.orderBy("chunk_index").collect():
        out.setdefault(r["doc_id"], []).append(r["content"])
    return out


def greedy(parts, glue, size):
    out = []
    for p in (x.strip(" ") for x in parts):
        if p and out and len(out[-1]) + len(p) + len(glue) <= size:
            out[-1] += glue + p
        elif p:
            out.append(p)
    return out


def test_sentences_and_paragraphs(spark):
    for size in (30, 100):
        want = {i: w for i, t in enumerate(TEXTS) if (w := greedy(re.split(r"(?<=[.!?])\s+", t), " ", size))}
        assert chunks(ch.sentence_chunks(frame(spark), size=size)) == want
        want = {i: w for i, t in enumerate(TEXTS) if (w := greedy(re.split(r"\n{2,}", t), "\n\n", size))}
        assert chunks(ch.paragraph_chunks(frame(spark), size=size)) == want


def test_windows_cover_the_text(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("abc ", k=n))) for i, n in enumerate((1, 99, 100, 101, 180, 181, 260, 500, 561))]
    got = chunks(ch.fixed_windows(spark.createDataFrame(rows, "doc_id long, text string"), size=100, overlap=20, least=10, most=150))
    for i, t in rows:
        whole = got[i][0] + "".join(c[20:] for c in got[i][1:])
        assert whole == t and all(len(c) <= 150 for c in got[i])


def test_tables_repeat_their_header(spark):
    got = chunks(ch.table_chunks(frame(spark)))[4]
    assert len(got) == 3 and all(c.startswith("a|b\n") for c in got)
    assert sum(c.count("\n") for c in got) == 60


def test_structure(spark):
    got = ch.structured_chunks(ch.line_blocks(frame(spark))).where("doc_id = 3").orderBy("section").collect()
    assert [r["heading"] for r in got] == ["Heading", "Head Two"] or got[0]["heading"] == "Heading"
    assert "".join(r["content"] for r in got).count("x") >= 300
    tree = {r["heading"]: r["section_id"] for r in ch.hierarchy(ch.line_blocks(frame(spark))).where("doc_id = 3").collect()}
    assert tree["Heading"] == 1


def test_recursive_chunks_overlap(spark):
    text = " ".join(f"word{i}" for i in range(600))
    ends = list(ch.split_ends(text, 200, 30))
    assert ends[0][0] == 0 and ends[-1][1] == len(text) and all(b[0] == a[1] - 30 for a, b in zip(ends[:-1], ends[1:], strict=True))
    rows = [(0, f"  {text}\n"), (1, None), (2, " \n"), (3, "x" * 450), (4, "short one"), (5, "a\n\n" * 300)]
    got = chunks(ch.recursive_chunks(spark.createDataFrame(rows, "doc_id long, text string"), size=200, overlap=30))
    assert got[0] == [text[a:b].strip() for a, b in ends] and max(map(len, got[0])) <= 200
    assert set(got) == {0, 3, 4, 5} and got[3] == ["x" * 200, "x" * 200, "x" * 110] and got[4] == ["short one"]
    assert all(c.startswith("a") and c.endswith("a") for c in got[5])


def test_packing_takes_time_in_proportion(spark):
    import time

    sizes = np.full(1_000_000, 11, np.int64)
    began = time.time()
    runs = list(ch.breaks(sizes, 1, 1600))
    assert time.time() - began < 2 and runs[0] == (0, 133) and runs[-1][1] == 1_000_000
    assert all(b - a == 133 for a, b in runs[:-1])
    text = "a sentence. " * 1_000_000
    began = time.time()
    got = ch.sentence_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).agg(F.count(F.lit(1)), F.sum(F.length("content"))).first()
    assert got[0] == 7519 and got[1] == 12_000_000 - 7519 and time.time() - began < 60


def test_finalize(spark):
    rows = [(1, 0, "Same  text"), (1, 1, "same text"), (1, 2, " "), (1, 3, "other"), (1, 4, "y" * 3001), (2, 0, "same text")]
    got = {(r["doc_id"], r["content"][:5], r["reject_reason"]): r["chunk_index"] for r in ch.finalize(spark.createDataFrame(rows, "doc_id long, chunk_index int, content string")).collect()}
    assert got == {(1, "Same ", None): 0, (1, "same ", "duplicate"): None, (1, "", "empty"): None, (1, "other", None): 1, (1, "yyyyy", "too long"): None, (2, "same ", None): 0}


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(80, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    asked = df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ve.vector_search(df, asked, 4).collect()}
    unit = v / np.sqrt((v.astype(float) ** 2).sum(axis=1, keepdims=True))
    for q in range(3):
        assert [got[q, k] for k in range(1, 5)] == np.argsort(-(unit @ unit[q]), kind="stable")[:4].tolist()
    bad = spark.createDataFrame([(1, [1.0]), (2, None), (3, [float("nan")] * 8)], "vec_id long, embedding array<float>")
    assert [r["reason"] for r in re_.invalid_vectors(bad, "embedding", 8).orderBy("vec_id").collect()] == ["width", "missing", "not finite"]


def test_access_rules(spark):
    rows = [("t", None, [], [], [], "o"), ("t", "secret", [], [], [], "o"), ("t", "confidential", [], [], [], "o"), ("u", "public", [], [], [], "o"), ("t", "public", ["x"], [], [], "o"), ("t", "public", [], ["r"], [], "o"), ("t", "public", ["x"], [], [], "me")]
    df = spark.createDataFrame(rows, "tenant_id string, classification string, allowed_users array<string>, allowed_roles array<string>, allowed_departments array<string>, owner_id string")
    none = F.array().cast("array<string>")
    ok = df.select(re_.may_read(F.lit("t"), "internal", F.lit("me"), F.array(F.lit("r")), none).alias("x")).toPandas()["x"].tolist()
    assert ok == [True, False, False, False, False, True, True]


def test_small_retrieval_pieces(spark):
    df = spark.createDataFrame([("compare loans and overdue payments, ok",), ("short",)], "q string")
    assert df.select(re_.sub_queries("q").alias("p")).toPandas()["p"].map(list).tolist() == [["compare loans", "overdue payments"], ["short"]]
    rows = spark.createDataFrame([(1, 0.9, "a" * 50), (1, 0.8, "b" * 50), (1, 0.7, "c")], "query_id long, score double, content string")
    got = re_.packed_context(rows, 70).first()
    assert got["used"] == 1 and got["left_out"] == 2
    terms = spark.createDataFrame([(1, 7, 2.0), (1, 8, 1.0)], "query_id long, doc_id long, score double")
    vecs = spark.createDataFrame([(1, 7, 3.0), (1, 9, 0.5)], "query_id long, doc_id long, score double")
    assert [(r["doc_id"], r["score"], r["source"]) for r in re_.hybrid(terms, vecs, 2).orderBy("rank").collect()] == [(7, 3.0, "both"), (8, 1.0, "terms")]


def test_walk(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "r", "d")], "src string, rel string, dst string")
    got = {(r["src"], r["dst"]): r["depth"] for r in re_.walk(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 2, ("c", "a"): 3, ("c", "d"): 3}


def test_incremental_embedding(spark):
    calls = spark.sparkContext.accumulator(0)
    embed = me.hashing_embedder(8)

    def counted(texts):
        calls.add(len(texts))
        return embed(texts)

    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "xyz")], "id long, text string")
    empty = spark.createDataFrame([], "cache_key string, vector array<float>")
    _, made = me.embed_incrementally(df, empty, counted, "m")
    cache = spark.createDataFrame(made.collect(), made.schema)
    assert cache.count() == 2 and calls.value == 2
    rows, more = me.embed_incrementally(df, cache, counted, "m")
    assert more.count() == 0 and rows.where("vector is null").count() == 0 and calls.value == 2


def test_query_blocks_meet_every_row(spark, monkeypatch):
    v = np.random.default_rng(3).random((90, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = sorted(map(tuple, ve.vector_search(df, asked, 4).collect()))
    monkeypatch.setattr(ve, "QUERY_LIMIT", 7)
    got = ve.vector_search(df, asked, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert sorted(map(tuple, got.collect())) == want and len(want) == 180


def test_searches_ask_every_fiftieth_row(spark):
    from tessera.plans import texts

    for name in ("v03_dot_search", "v04_cosine_search", "v05_l2_search", "v06_approximate_search", "v07_filtered_search", "v09_rerank", "y04_recall"):
        got = texts.C.queries[name](spark, "/root/testdata/sf0.001")
        assert sorted(r[0] for r in got.select("query_id").distinct().collect()) == list(range(0, 500, 50))
    for name in ("v02_bm25", "v08_hybrid", "v12_retrieve"):
        assert {r[0] for r in texts.C.queries[name](spark, "/root/testdata/sf0.001").select("query_id").distinct().collect()} >= {0}


def near_rows(rng, n, width):
    """Vectors around few centres, with ties, an unwanted width, a null and one that isn't finite."""
    v = rng.normal(size=(8, width))[rng.integers(0, 8, n)] + 0.4 * rng.normal(size=(n, width))
    v[5], v[17] = v[4], v[4]
    rows = [(i, int(i % 3), x.tolist()) for i, x in enumerate(np.round(v, 3))]
    return [*rows, (n, 0, [1.0]), (n + 1, 1, None), (n + 2, 2, [float("inf")] * width)]


def test_block_products_match_pairs(spark, monkeypatch):
    rows = near_rows(np.random.default_rng(8), 60, 6)
    df = spark.createDataFrame(rows, "vec_id long, kind int, embedding array<double>").repartition(5)
    asked = df.where("vec_id % 4 = 0 and vec_id < 60").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = {i: np.array(x) for i, _, x in rows[:60]}
    kinds = {i: k for i, k, _ in rows}

    def score(a, b, metric):
        if metric == "l2":
            return round(1 / (1 + float(((a - b) ** 2).sum())), 6)
        return round(float(a @ b) / (1 if metric == "dot" else float(np.sqrt(a @ a) * np.sqrt(b @ b))), 6)

    def plain(metric, k, per_kind):
        out = set()
        for q in range(0, 60, 4):
            found = sorted((-score(whole[q], x, metric), i) for i, x in whole.items())
            if per_kind:
                found = sorted(x for kind in range(3) for x in [f for f in found if kinds[f[1]] == kind][:k])
            out |= {(q, i, -s, rank) for rank, (s, i) in enumerate(found[:k], 1)}
        return out

    for limit in (4096, 4):
        monkeypatch.setattr(ve, "QUERY_LIMIT", limit)
        for metric in ("dot", "cosine", "l2"):
            found = ve.vector_search(df, asked, 5, metric)
            assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
            assert {(r["query_id"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in found.collect()} == plain(metric, 5, False)
    found = ve.recall(df, asked, "kind", 4).collect()
    assert {(r["query_id"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in found} == plain("l2", 4, True)
    none = df.limit(0)
    assert ve.vector_search(none, asked, 5).count() == 0 and ve.vector_search(df, asked.limit(0), 5).count() == 0


def test_hybrid_filters_before_or_after_the_cut(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i < 4 else "gamma", "en" if i % 2 else "fr") for i in range(120)], "doc_id long, text string, lang string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(120)], "doc_id long, embedding array<double>")
    queries, asked = spark.createDataFrame([(1, "alpha")], "query_id long, query string"), spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, query_vector array<double>")
    run = lambda mode: [r["doc_id"] for r in re_.hybrid_search(docs, vectors, queries, asked, 40, docs, F.col("lang") == "en", mode).orderBy("rank").collect()]
    pre, post = run("pre"), run("post")
    assert len(pre) == 40 and len(post) == 40 and all(i % 2 for i in pre + post)
    few = [r["doc_id"] for r in re_.hybrid_search(docs, vectors, queries, asked, 10, docs, F.col("doc_id") >= 70, "post").collect()]
    many = [r["doc_id"] for r in re_.hybrid_search(docs, vectors, queries, asked, 10, docs, F.col("doc_id") >= 70, "pre").collect()]
    assert few == [] and len(many) == 10


def test_visibility_equals_every_user_with_every_document(spark):
    rng = random.Random(9)
    some = lambda pool, p: [] if rng.random() < p else rng.sample(pool, rng.randint(1, 2))
    users = [(f"u{i}", f"t{i % 2}", rng.choice(("public", "Internal", "confidential", "restricted", "other", None)), some(["analyst", "clerk", "admin"], 0.4), some(["d1", "d2"], 0.5)) for i in range(25)]
    docs = [
        (i if i != 4 else None, rng.choice(("t0", "t1", "t2", None)), rng.choice(("public", "internal", "CONFIDENTIAL", "restricted", "secret", None)),
         rng.choice((None, [], ["u1", "u2", None], ["u3"])), some(["analyst", "clerk"], 0.6), some(["d1", "d2"], 0.7), f"u{rng.randint(0, 30)}")
        for i in range(400)
    ]
    kinds = "tenant_id string, classification string, allowed_users array<string>, allowed_roles array<string>, allowed_departments array<string>, owner_id string"
    left = spark.createDataFrame(docs, f"doc_id long, {kinds}")
    right = spark.createDataFrame(users, "user_id string, tenant_id string, clearance string, roles array<string>, departments array<string>")
    found = re_.visibility(left, right)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    both = left.crossJoin(right.withColumnRenamed("tenant_id", "_t"))
    ok = re_.may_read(F.col("_t"), F.col("clearance"), F.col("user_id"), F.col("roles"), F.col("departments"))
    want = {r["user_id"]: r["n"] for r in both.where(ok).groupBy("user_id").agg(F.count("doc_id").alias("n")).where("n > 0").collect()}
    assert {r["user_id"]: r["visible"] for r in found.collect()} == want and len(want) > 10


def test_near_documents_find_what_all_pairs_find(spark):
    from difflib import SequenceMatcher

    rng = random.Random(12)
    stock = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (5, "One"), (6, "two words"), (7, ""), (None, "x y z w")]
    for i in range(10, 70):
        old = [t for n, t in rows if n and n >= 10]
        if old and rng.random() < 0.6:
            words = rng.choice(old).split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(stock)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choices(stock, k=rng.randint(20, 90)))))
    base = rng.choices(stock, k=60)  # many edits of one text
    for i in range(100, 160):
        words = list(base)
        words[i - 100] = "edited"
        rows.append((i, " ".join(words)))
    first, sets = {}, {}
    for i, t in rows:
        if i is not None and t is not None:
            first.setdefault(t, i)
            w = t.lower().split()
            sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)}
    text = {i: t for i, t in rows if i in sets}
    want = {i: {j for j in first.values() if j < i and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])} for t, i in first.items() if t.strip()}
    want = {i: near for i, near in want.items() if near and text[i].strip()}
    got = {r["doc_id"]: r for r in do.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    copies = {i for i, t in text.items() if first[t] != i}
    assert copies and all(got[i]["near_id"] == first[text[i]] and got[i]["ratio"] == 100 for i in copies)
    linked = {i: r for i, r in got.items() if i not in copies}
    assert all(r["near_id"] in want[i] for i, r in linked.items())
    found = len(linked) / len(want)
    print(f"recall {found:.3f} of {len(want)} documents")
    assert found >= 0.95
    for i, r in list(linked.items())[:20]:
        assert r["ratio"] == round(SequenceMatcher(None, text[r["near_id"]], text[i]).ratio() * 100, 2)
    assert do.near_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_embedder_counts_trigrams_of_each_text():
    import pandas as pd

    embed = me.hashing_embedder(32)
    texts = ["abcd", "", None, "ab", "xyzé😀", "abcdabcd"]
    got = np.array(embed(pd.Series(texts)))
    each = np.array([embed(pd.Series([t]))[0] for t in texts])
    assert np.array_equal(got, each) and (got[1:4] == 0).all()
    assert np.allclose(np.sqrt((got[[0, 4, 5]] ** 2).sum(axis=1)), 1)
    parts = [np.array(embed(pd.Series([t]))[0]) for t in ("abc", "bcd", "cda", "dab")]
    want = 2 * parts[0] + 2 * parts[1] + parts[2] + parts[3]
    assert np.allclose(got[5], want / np.sqrt((want**2).sum()), atol=1e-6)


def test_entities_beside_letters_that_are_not_ascii(spark, tmp_path):
    """Words of ASCII letters, as DuckDB has them: "stände" holds the word "st", a vertical tab is no blank, a long s is an s without regard to case."""
    rows = ["12 Elm stände", "12 Elm\x0bSt", "12 Elm ſt", "12 oaK St", "ä12 Elm St", "7 İ St", "ä2001-02-03 2001-02-03é 1/2/99_", "100\x0bUSD", "5\x0c ETB", "12 Elm St", "", None]
    pd.DataFrame({"doc_id": range(len(rows)), "text": rows}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(texts.C.sql["x11_entities"]).fetchall()
    got = [tuple(r) for r in texts.C.queries["x11_entities"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert dict((r[0], r[6]) for r in want)[0] == "12 Elm st"


def test_shingles_split_each_text_once(spark):
    """Split anew for every run, a text of 20000 words took its square of time."""
    rng = random.Random(4)
    rows = ["", "  ", "One", "two  Words", "a b A B a b a", " ".join(rng.choices("abcdefgh", k=20000)), None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", do.shingles("t").alias("s"))
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1
    got = {r["i"]: r["s"] for r in df.collect()}
    for i, t in enumerate(rows[:-1]):
        w = t.lower().split()
        assert got[i] == (list(dict.fromkeys(" ".join(w[j : j + 3]) for j in range(len(w) - 2))) if len(w) > 2 else [" ".join(w)])
