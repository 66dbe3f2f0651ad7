"""The registered queries of the operators on the smallest tables: columns, splits, thresholds and values."""

import os
import zlib

import pytest

from tessera.llm import common, queries

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()}


def run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    return df.dtypes, df.collect()


def held(i, divisor, remainder):
    return zlib.crc32(str(i).encode()) % divisor == remainder


def test_op1(spark, texts):
    kinds, rows = run(spark, "op1_language_id")
    assert kinds[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    docs = common.table(spark, SF, "documents").select("doc_id", "lang").collect()
    learned = {r["lang"] for r in docs if r["lang"] and not held(r["doc_id"], 3, 1)}
    got = {r["doc_id"]: r for r in rows}
    for i, r in got.items():
        assert r["held_out"] == held(i, 3, 1) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in texts[i] or "")
        assert r["lang_pred"] in learned if letters else r["lang_pred"] == "und"
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs if r["lang"] and got[r["doc_id"]]["held_out"] and got[r["doc_id"]]["lang_pred"] != "und"]
    assert sum(right) >= 0.95 * len(right)


def test_op2(spark, texts):
    from tessera.llm.sentencepiece_sampling import decode, default_model

    df = queries.QUERIES["op2_sentencepiece"](spark, SF)
    rows = df.collect()
    assert all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert {r["doc_id"]: r["text"] for r in decode(df, default_model()).collect()} == {i: t or "" for i, t in texts.items()}


def test_op3(spark, texts):
    kinds, rows = run(spark, "op3_suffix_dedup")
    assert kinds == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert {r[0]: tuple(r)[1:] for r in rows} == brute.suffix(texts.items())


def test_op4(spark, texts):
    _, rows = run(spark, "op4_quality_rules")
    for r in rows:
        want = brute.rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize(("name", "limit"), [("op5_quality_classifier", 0.3), ("op9_toxicity", 0.5)])
def test_op5_and_op9(spark, texts, name, limit):
    kinds, rows = run(spark, name)
    assert kinds[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], 5, 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= limit)


def test_op6(spark, texts):
    _, rows = run(spark, "op6_exact_dedup")
    want = brute.exact(texts.items())
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows} == want
    assert all(r["kept"] == (r["keep_id"] == r["doc_id"]) for r in rows)


def test_op7(spark, texts):
    from .test_operators import plain_line_dedup

    few = {i: t for i, t in texts.items() if len(t or "") < 1500}
    want = plain_line_dedup(sorted(few.items()), 2, 5)
    from tessera.llm.line_dedup import line_dedup

    got = line_dedup(spark.createDataFrame(list(few.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["kept_text"], r["n_linked"], r["class_id"]) for r in got} == want
    kinds, rows = run(spark, "op7_line_dedup")
    assert [k for k, _ in kinds] == ["doc_id", "n_lines", "n_removed", "n_linked", "class_id", "kept_sha256"]
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)


def test_op8(spark, texts):
    kinds, rows = run(spark, "op8_packing")
    assert [k for k, _ in kinds] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole, bins = {}, {}
    for r in rows:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(whole) == set(texts) and all(whole[r["doc_id"]] == r["doc_tokens"] for r in rows)
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b[:-1], b[1:], strict=True)) and sum(b[-1]) <= 1024
    assert sum(whole.values()) >= 0.95 * 1024 * len(bins) - 1024


def test_op10(spark, texts):
    kinds, rows = run(spark, "op10_minhash")
    assert kinds == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.near(list(texts.items()), 4, 80)
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in rows)


def test_temporary_tables_go(spark, tmp_path):
    with common.temporary(spark):
        inner = common.materialize(spark.range(5).toDF("x"))
        outer = common.materialize(inner, outlives=True)
        path = inner.inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://")) and outer.count() == 5
