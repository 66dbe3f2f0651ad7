import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import core as co
from tessera.operators import documents as do
from tessera.operators import finance as fi
from tessera.operators import operations as op
from tessera.operators import profiling as pr
from tessera.plans import sales


def one(spark, expr, rows, schema):
    return spark.createDataFrame(rows, schema).select(expr.alias("x")).toPandas()["x"].tolist()


def test_division(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (None, 1.0), (float("nan"), 1.0), (1.0, None)]
    assert one(spark, co.safe_divide("a", "b", 100), rows, "a double, b double") == [50.0, 0.0, 0.0, 0.0, 0.0]
    assert one(spark, co.safe_divide_eps("a", "b"), [(1.0, 1e-8), (1.0, 2.0)], "a double, b double") == [0.0, 0.5]
    assert one(spark, co.safe_pct("a", "b"), [(1.0, 3.0), (1.0, -1.0)], "a double, b double") == [33.33, 0.0]


def test_parsing(spark):
    got = one(spark, co.parse_number("a"), [("$1,200.5",), ("12%",), ("n/a",), ("",), (None,)], "a string")
    assert got[:2] == [1200.5, 12.0] and all(v != v or v is None for v in got[2:])
    assert one(spark, co.map_label("a"), [("Closed-Won",), (" mql ",), ("odd  one",), ("",), (None,)], "a string") == ["converted", "qualified", "odd one", "unknown", "unknown"]


def test_days_are_whole_periods(spark):
    rows = [("2024-01-01 12:00:00", "2024-01-02 11:59:59"), ("2024-01-01 12:00:00", "2024-01-02 12:00:00"), ("2024-01-02 00:00:00", "2024-01-01 23:00:00")]
    assert one(spark, co.days_between(F.to_timestamp("a"), F.to_timestamp("b")), rows, "a string, b string") == [0, 1, -1]


def test_statistics_match_pandas(spark):
    rng = np.random.default_rng(1)
    x = pd.Series(rng.gamma(2, 3, 101))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = df.agg(co.bias_corrected_skew("x").alias("s")).join(co.exact_quantiles(df, {"q": ("x", 0.3)})).join(co.smallest_mode(df, F.round("x"), "m")).first()
    assert got["s"] == pytest.approx(x.skew())
    assert got["q"] == pytest.approx(x.quantile(0.3))
    assert got["m"] == x.round().mode().min()
    t = pd.Series(rng.integers(0, 9, 60))
    ranked = spark.createDataFrame(pd.DataFrame({"t": t})).transform(lambda d: co.with_pct_ranks(d, {"p": F.col("t")})).toPandas()
    assert sorted(ranked["p"]) == pytest.approx(sorted(t.rank(pct=True)))


def test_columns(spark):
    df = spark.createDataFrame([(1, None, None), (None, None, None)], "`Lead ID ` int, status string, junk string")
    assert co.resolve_columns(df.schema, {"id": ["lead_id"], "none": ["x"]}) == {"id": "Lead ID ", "none": None}
    clean = co.drop_empty(df)
    assert clean.columns == ["Lead ID"] and clean.count() == 1


@pytest.mark.parametrize("build", [
    lambda d: fi.receivables(d), lambda d: fi.cash_flow(d, "kind", "amount"), lambda d: op.shipments(d, cost="amount", weight="amount_paid", days="days_outstanding", on_time="flag"), lambda d: pr.missing_profile(d), lambda d: pr.table_quality(d), lambda d: pr.numeric_profile(d, ["amount"]),
])
def test_empty_and_null_tables(spark, build):
    schema = "amount double, amount_paid double, days_outstanding int, kind string, flag boolean"
    for rows in ([], [(None,) * 5], [(1.0, None, None, None, None), (float("nan"), 1.0, 400, "inflow", True)]):
        assert build(spark.createDataFrame(rows, schema)).count() >= 1


def test_abc_classes_at_many_partitions(spark):
    rows = [(i, float(i % 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "sku long, value double")
    want = pd.DataFrame(rows, columns=["sku", "value"]).sort_values(["value", "sku"], ascending=[False, True])
    share = (want["value"].cumsum() / want["value"].sum() * 100).round(4)
    want = dict(zip(want["sku"], np.where(share <= 80, "A", np.where(share <= 95, "B", "C")), strict=True))
    for n in (1, 7):
        assert {r["sku"]: r["class"] for r in op.abc_classes(df.repartition(n)).collect()} == want


def test_entities_and_redaction(spark):
    text = "Ann Lee of 12 Main Street wrote a.b@c.org on 2024-01-02, see https://x.org/a"
    got = do.extract_entities(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert got[0]["emails"] == ["a.b@c.org"] and got[0]["dates"] == ["2024-01-02"] and got[0]["urls"] == ["https://x.org/a"] and got[1]["emails"] == []
    hidden = spark.createDataFrame([(text,)], "text string").select(do.redact("text")).first()[0]
    assert "a.b@c.org" not in hidden and "[EMAIL]" in hidden and "Ann Lee" not in hidden
    assert one(spark, do.script_language("a"), [("привет",), ("hello",), ("مرحبا",), ("你好",)], "a string") == ["Russian", "English", "Arabic", "Chinese"]


def test_pair_similarity(spark):
    got = do.pair_similarity(spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")).toPandas()["ratio"].tolist()
    assert got == [75.0, 0.0]


def test_exact_quantiles_of_many_rows_groups_and_nothing(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(co, "ACCURACY", 100)  # the sketch encloses a twentieth of the rows only
    rng = np.random.default_rng(5)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 4000), np.round(rng.lognormal(size=4000), 2), strict=True)] + [(3, None), (4, 7.0)]
    df = spark.createDataFrame(rows, "g int, x double")
    wanted = {f"p{p}": ("x", p / 100) for p in (0, 25, 50, 99, 100)} | {"half": (F.col("x") / 2, 0.5)}
    x = np.array([v for _, v in rows if v is not None])
    got = co.exact_quantiles(df, wanted).first()
    assert [got[f"p{p}"] for p in (0, 25, 50, 99, 100)] == pytest.approx(np.percentile(x, [0, 25, 50, 99, 100]))
    assert got["half"] == pytest.approx(np.median(x) / 2)
    for r in co.exact_quantiles(df, {"m": ("x", 0.5)}, ["g"]).collect():
        assert r["m"] == pytest.approx(np.median([v for g, v in rows if g == r["g"] and v is not None]))
    assert co.exact_quantiles(df.where("g = 9"), {"m": ("x", 0.5)}).first()["m"] is None


def test_ranks_by_ranges_equal_ranks_in_one_piece(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = [None if v > 37 else float(v) for v in rng.integers(0, 40, 400)]
    rows = [(i, x[i], (None, "a", "b")[int(rng.integers(0, 3))] if i % 3 else "a") for i in range(400)]
    df = spark.createDataFrame(rows, "i long, x double, g string").repartition(7)
    for ranges in (3, 200):
        monkeypatch.setattr(co, "RANGES", ranges)
        whole = co.with_pct_ranks(df, {"p": F.col("x"), "q": -F.col("x")})
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        got = {r["i"]: (r["p"], r["q"]) for r in whole.collect()}
        t = pd.DataFrame(rows, columns=["i", "x", "g"]).set_index("i")
        up, down = (s.fillna(-1e9).rank(pct=True) for s in (t["x"], -t["x"]))
        assert len(got) == 400 and all(got[i] == (pytest.approx(up[i]), pytest.approx(down[i])) for i in range(400))
        got = {r["i"]: r["p"] for r in co.with_pct_ranks(df, {"p": F.col("x")}, ["g"]).collect()}
        each = t["x"].fillna(-1e9).groupby(t["g"].fillna("")).rank(pct=True)
        assert all(got[i] == pytest.approx(each[i]) for i in range(400))
    assert co.with_pct_ranks(df.limit(0), {"p": F.col("x")}).count() == 0


def test_a_series_in_blocks_equals_one_piece(spark, monkeypatch):
    from tessera.operators import profiling as pr

    monkeypatch.setattr(co, "RANGES", 9)
    rng = np.random.default_rng(2)
    rows = [(f"2024-01-01 {i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}", float(v), "ab"[i % 7 == 0]) for i, v in enumerate(rng.normal(50, 9, 300))]
    df = spark.createDataFrame(rows, "at string, v double, g string").withColumn("ts", F.to_timestamp("at")).repartition(5)
    for by in ([], ["g"]):
        small, whole = (sorted(map(str, pr.indicators(df, "ts", "v", by, size=n).select("at", "moving_average", "band_low", "momentum", "rsi", "volatility").collect())) for n in (25, 100_000))
        assert len(small) == 300 and small == whole
        small, whole = (sorted(map(str, pr.series_statistics(df, "ts", "v", by, size=n).collect())) for n in (4, 100_000))
        assert small == whole
    blocks = co.in_blocks(df, "ts", halo=3, size=10)
    assert blocks.where("not _halo").count() == 300 and blocks.select("_block").distinct().count() == 31
    per = blocks.where("_block = 4").orderBy("_pos").collect()
    assert [r["_pos"] for r in per] == list(range(37, 50)) and [r["_halo"] for r in per] == [True] * 3 + [False] * 10


def test_efficiency_adds_lines_in_the_order_of_the_files(spark, tmp_path):
    """Scores to all four places as one thread of DuckDB has them; partial sums of two files have other last bits, which move ranks."""
    rng, n, folder = np.random.default_rng(3), 2000, tmp_path / "lineitem.parquet"
    folder.mkdir()
    for part in range(2):
        price, tax = rng.integers(100, 120, 2 * n) / 10, rng.integers(1, 4, 2 * n) / 100
        lines = {"l_orderkey": np.repeat(np.arange(n), 2), "l_returnflag": "A", "l_tax": tax, "l_extendedprice": price, "l_discount": rng.integers(0, 10, 2 * n) / 100, "l_quantity": 1.0, "l_shipdate": pd.Timestamp("2001-01-01")}
        pd.DataFrame(lines).to_parquet(folder / f"{part}.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.execute("SET threads=1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    want = con.execute(sales.C.sql["m10_efficiency"]).fetchall()
    got = sales.C.queries["m10_efficiency"](spark, str(tmp_path)).collect()
    assert sorted((r["campaign_id"], r["score"]) for r in got) == sorted(want)


def test_sums_in_order(spark):
    rows = [("a", 2, 1e16), ("a", 1, 1.0), ("a", 3, -1e16), ("a", 4, None), ("b", 1, None), (None, 2, 1.5), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, i int, x double").repartition(4)
    assert {r["g"]: r["s"] for r in co.sums_in_order(df, ["g"], {"s": F.col("x")}, [F.col("i")]).collect()} == {"a": 0.0, "b": None, None: 3.5}
