import corpus_pipeline
from tessera.llm import packing

from . import brute
from .test_operators import SCHEMA, made_up


def test_stages_match_brute_force(spark, tmp_path):
    rows = [(i, t, "en" if i % 2 else None, "s", 0) for i, t in made_up(seed=3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = dict(made_up(seed=3))
    docs = {i: t for i, t in docs.items() if any(c.isalpha() for c in t or "")}
    exact = brute.exact(docs.items())
    docs = {i: t for i, t in docs.items() if exact[i][0] == i}
    near = brute.near(docs.items(), 5, 80)
    docs = {i: t for i, t in docs.items() if near[i][1] == i}

    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == list(corpus_pipeline.COLUMNS), name
    assert {r["doc_id"]: r["text"] for r in frame.collect()} == docs
    assert all(r["lang"] for r in frame.collect())
    cut = corpus_pipeline.cut_repeats(spark, frame, str(tmp_path))
    assert cut.columns == list(corpus_pipeline.COLUMNS)
    sizes = brute.suffix(docs.items())
    for r in cut.collect():
        n, gone, spans, _ = sizes[r["doc_id"]]
        assert 0 <= len(r["text"].encode()) - (n - gone) <= 6 * spans
        assert r["n_chars"] == len(r["text"])

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(docs)
    again = packing.pack(cut, packing.default_tokenizer()).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, packed)) == sorted(map(key, again))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_rows_do_no_harm(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "some words here", None, None, None), (1, "some words here", "en", "s", 3), (1, "some words here", "en", "s", 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "None"]


def test_texts_of_one_id_are_judged_apart(spark, tmp_path):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, f"{b} more"), (2, c.replace(" ", "  ", 3)), (2, c), (None, a), (4, f"{a} less")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.drop_exact_copies(spark, spark.read.parquet(str(tmp_path / "d")), "")
    want = [(1, a), (2, b), (2, c.replace(" ", "  ", 3)), (3, f"{b} more"), (4, f"{a} less"), (None, a)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    kept.write.parquet(str(tmp_path / "e"))
    left = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "e")), "")
    assert left.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([want[0], want[1], want[2], want[5]], key=str)
