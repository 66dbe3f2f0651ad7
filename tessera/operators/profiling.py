"""Profiles of tables, statistics of surveys, series and several sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampType
from pyspark.sql.window import Window

from tessera.functions.core import MICROS_PER_DAY, bias_corrected_skew, col, corr_matrix, exact_quantiles, in_blocks, micros, numeric_columns, r, safe_divide, same, smallest_mode, value_counts, with_quantiles


def _long(df: DataFrame, measures: dict[str, list[Column]], names: Sequence[str]) -> DataFrame:
    """One row per column from one aggregate over the table."""
    flat = df.agg(*[m.alias(f"{i}_{n}") for i, ms in enumerate(measures.values()) for m, n in zip(ms, names, strict=True)])
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{i}_{n}").alias(n) for n in names]) for i, c in enumerate(measures)]
    return flat.select(F.inline(F.array(*rows)))


def missing_profile(df: DataFrame) -> DataFrame:
    """column_name, missing, missing_pct, for every column."""
    return _long(df, {c: [F.count_if(F.col(c).isNull()), r(safe_divide(F.count_if(F.col(c).isNull()), F.count(F.lit(1)), 100.0))] for c in df.columns}, ["missing", "missing_pct"])


def table_quality(df: DataFrame) -> DataFrame:
    """One row: rows, cells missing, duplicates, score and grade, kinds of columns, consistency flags.

    Off 100: 20 if more than a tenth of the cells is missing, 15 if more than a twentieth of the rows are repeats, 15 if any cell is null.
    """
    per_row = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0)).alias("_null")
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"), F.first(per_row).alias("_null"))
    one = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("_n") * F.col("_null")), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    one = one.withColumns({
        "missing_pct": r(safe_divide("missing_cells", F.col("row_count") * len(df.columns), 100.0)),
        "duplicate_pct": r(safe_divide("duplicate_rows", "row_count", 100.0)),
    })
    score = 100 - F.when(F.col("missing_pct") > 10, 20).otherwise(0) - F.when(F.col("duplicate_pct") > 5, 15).otherwise(0) - F.when(F.col("missing_cells") > 0, 15).otherwise(0)
    kinds = {"numeric_columns": len(numeric_columns(df)), "string_columns": 0, "datetime_columns": 0}
    for f in df.schema.fields:
        kinds["string_columns"] += isinstance(f.dataType, StringType)
        kinds["datetime_columns"] += isinstance(f.dataType, TimestampType | DateType)
    one = one.withColumn("score", score).withColumns({k: F.lit(v) for k, v in kinds.items()})
    grade = F.when(F.col("score") >= 85, "EXCELLENT").when(F.col("score") >= 70, "GOOD").when(F.col("score") >= 50, "FAIR").otherwise("POOR")
    advice = F.when(F.col("missing_cells") > 0, F.format_string("Fill or drop %d missing cells.", "missing_cells")).otherwise("No missing cells.")
    return one.withColumns({"grade": grade, "consistent_lengths": F.col("missing_cells") == 0, "recommendation": advice})


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, mean, std, min, max, skew, missing_pct, outliers (beyond the quartile fences)."""
    columns = columns or numeric_columns(df)
    names = ["mean", "std", "min", "max", "skew", "missing_pct"]
    stats = _long(df, {c: [r(F.avg(c)), r(F.stddev_samp(c)), r(F.min(c).cast("double")), r(F.max(c).cast("double")), r(bias_corrected_skew(c)), r(safe_divide(F.count_if(F.col(c).isNull()), F.count(F.lit(1)), 100.0))] for c in columns}, names)
    fences = exact_quantiles(df, {f"{i}_{q}": (c, p) for i, c in enumerate(columns) for q, p in (("a", 0.25), ("b", 0.75))})
    marked = df.select(*columns).join(F.broadcast(fences))

    def beyond(i: int, c: str) -> Column:
        a, b = F.col(f"{i}_a"), F.col(f"{i}_b")
        return F.count_if((F.col(c) < a - 1.5 * (b - a)) | (F.col(c) > b + 1.5 * (b - a)))

    return stats.join(F.broadcast(_long(marked, {c: [beyond(i, c)] for i, c in enumerate(columns)}, ["outliers"])), "column_name")


def string_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, distinct, empty, most_common (the smallest of the most frequent)."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    modes = [smallest_mode(df, c, "most_common").select(F.lit(c).alias("column_name"), F.col("most_common").cast("string")) for c in columns]
    most = modes[0]
    for more in modes[1:]:
        most = most.unionByName(more)
    return _long(df, {c: [F.count_distinct(c), F.count_if(F.col(c) == "")] for c in columns}, ["distinct", "empty"]).join(F.broadcast(most), "column_name", "left")


def class_distribution(df: DataFrame, c: str, most: int = 20) -> DataFrame:
    """label, count of a column that is text or has fewer than ``most`` values; else nothing."""
    counts = value_counts(df.select(F.col(c).cast("string").alias("label")), "label")
    if isinstance(df.schema[c].dataType, StringType):
        return counts
    few = df.agg(F.count_distinct(c).alias("_k")).where(F.col("_k") < most)
    return counts.join(F.broadcast(few)).drop("_k")


def correlated_pairs(df: DataFrame, columns: Sequence[str], above: float = 0.8) -> DataFrame:
    return corr_matrix(df, columns).where(F.abs("r") > above).select("a", "b", r("r").alias("r"))


def readiness(df: DataFrame) -> DataFrame:
    """One row: null_share, verdict, suggested models, needs_preprocessing."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    one = df.agg(r(safe_divide(nulls, F.count(F.lit(1)) * len(df.columns))).alias("null_share"))
    ready = F.col("null_share") < 0.1
    has_text = any(isinstance(f.dataType, StringType) for f in df.schema.fields)
    return one.select("null_share", F.when(ready, "READY").otherwise("NEEDS_WORK").alias("verdict"), F.lit(has_text).alias("needs_encoding"), (F.col("null_share") > 0).alias("needs_imputing"))


def source_correlation(df: DataFrame, source: str, metric: str, value: str, metrics: Sequence[str] | None = None, above: float = 0.7) -> DataFrame:
    """Pairs of metrics whose means by source correlate: (a, b, r, strong); a before b in the order of ``metrics``, else of their names.

    Means stay in long form: those of one source meet, and six sums for each pair of metrics give its correlation over the
    sources that have both. No list of metrics is gathered; a source has as many rows as it has metrics.
    """
    means = df.where(F.col(metric).isNotNull()).groupBy(F.col(source).alias("_s"), F.col(metric).alias("_m")).agg(F.avg(value).alias("_x")).where("_x is not null")
    if metrics is not None:
        place = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("_m"))
        means = means.withColumn("_o", place).where("_o > 0")
    else:
        means = means.withColumn("_o", F.col("_m"))
    left, right = (means.select("_s", *[F.col(c).alias(f"{c}{side}") for c in ("_m", "_x", "_o")]) for side in "ab")
    both = same(left, right, ["_s"]).where("_oa < _ob")
    x, y = F.col("_xa"), F.col("_xb")
    sums = both.groupBy("_ma", "_mb").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(e).alias(k) for k, e in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))])
    spread = F.sqrt(F.expr("greatest(n * xx - x * x, 0d)")) * F.sqrt(F.expr("greatest(n * yy - y * y, 0d)"))
    found = sums.withColumn("r", F.try_divide(F.expr("n * xy - x * y"), spread))
    return found.select(F.col("_ma").alias("a"), F.col("_mb").alias("b"), r("r").alias("r"), (F.abs("r") > above).alias("strong"))


def coverage(df: DataFrame, ts: str, days: int = 30) -> DataFrame:
    one = df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    span = F.floor((micros("last_ts") - micros("first_ts")) / MICROS_PER_DAY)
    return one.select("first_ts", "last_ts", span.alias("days"), F.when(span > days, "COMPLETE").otherwise("PARTIAL").alias("coverage"))


def nps(c: str | Column, least: float = 9, most: float = 6) -> Column:
    """Promoters minus detractors in percent of all rows; null on scales beyond ten."""
    c = col(c)
    return F.when(F.max(c) <= 10, safe_divide(F.count_if(c >= least) - F.count_if(c <= most), F.count(F.lit(1)), 100.0))


def satisfaction_tiers(df: DataFrame, c: str) -> DataFrame:
    """One row: satisfied, neutral, dissatisfied, on a scale of five if no value is above it, else of ten."""
    top = df.agg(F.max(c).alias("_top"))
    high, low = F.when(F.col("_top") <= 5, 4).otherwise(8), F.when(F.col("_top") <= 5, 3).otherwise(6)
    x = F.col(c)
    return df.select(c).join(F.broadcast(top)).agg(F.count_if(x >= high).alias("satisfied"), F.count_if((x >= low) & (x < high)).alias("neutral"), F.count_if(x < low).alias("dissatisfied"))


def grouped_mean(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """dimension, label, mean, n of each single key, in one pass by grouping sets."""
    sets = df.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(r(F.avg(value)).alias("mean"), F.count(value).alias("n"), F.grouping_id().alias("_g"))
    width = len(keys)
    which, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        mask = ((1 << width) - 1) ^ (1 << (width - 1 - i))
        which, label = F.when(F.col("_g") == mask, k).otherwise(which), F.when(F.col("_g") == mask, F.col(k).cast("string")).otherwise(label)
    return sets.select(which.alias("dimension"), label.alias("label"), "mean", "n").where("label is not null")


#: Rows of a series in one block; a window's task holds one block and the rows just before it.
SERIES_BLOCK = 100_000


def series_statistics(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), size: int = SERIES_BLOCK) -> DataFrame:
    """Per series (all rows are one, unless ``by`` says more): points, mean, std, min, max, median, slope per day, trend, volatility, variation, range, forecast horizon and sufficiency."""
    order = Window.partitionBy(*by, "_block").orderBy("_pos")
    step = in_blocks(df, ts, by, 1, size).withColumn("_pct", F.try_divide(F.col(value), F.lag(value).over(order)) - 1).where("not _halo")
    days = F.floor((micros(F.max(ts)) - micros(F.min(ts))) / MICROS_PER_DAY)
    slope = safe_divide(F.max_by(value, ts) - F.min_by(value, ts), days)
    n = F.count(value)
    one = step.groupBy(*by).agg(
        n.alias("points"), r(F.avg(value)).alias("mean"), r(F.stddev_samp(value)).alias("std"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max"),
        r(slope).alias("slope"), F.when(slope > 0, "UP").otherwise("DOWN").alias("trend"), r(F.stddev_samp("_pct")).alias("volatility"),
        r(F.stddev_samp(value) / (F.avg(value) + 1e-4)).alias("variation"), r(F.max(value) - F.min(value)).alias("range"),
        F.least(F.floor(n / 4), F.lit(12)).alias("horizon"), (n > 20).alias("sufficient"),
    )
    return with_quantiles(one, df, {"median": (value, 0.5)}, by)


def indicators(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), n: int = 20, rsi: int = 14, size: int = SERIES_BLOCK) -> DataFrame:
    """Adds moving average, band edges, volatility, momentum and relative strength over the last rows of a series."""
    order = Window.partitionBy(*by, "_block").orderBy("_pos")
    last, few = order.rowsBetween(-n + 1, 0), order.rowsBetween(-rsi + 1, 0)
    step = F.col(value) - F.lag(value).over(order)
    df = in_blocks(df, ts, by, max(n, rsi) + 1, max(size, max(n, rsi) + 1))
    df = df.withColumns({"_up": F.when(step > 0, step).otherwise(0.0), "_down": F.when(step < 0, -step).otherwise(0.0)})
    mean, std = F.avg(value).over(last), F.coalesce(F.stddev_samp(value).over(last), F.lit(0.0))
    up, down = F.avg("_up").over(few), F.avg("_down").over(few)
    return df.withColumns({
        "moving_average": r(mean, 6), "band_low": r(mean - 2 * std, 6), "band_high": r(mean + 2 * std, 6), "volatility": r(std),
        "momentum": r(F.col(value) - F.lag(value, n).over(order)), "rsi": r(F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, down)))),
    }).where("not _halo").drop("_up", "_down", "_pos", "_block", "_halo")


def negative_feedback(df: DataFrame, c: str, words: Sequence[str] = ("negative", "dissatisfied")) -> DataFrame:
    """One row: negative answers, and their share of all rows in percent."""
    bad = F.count_if(F.lower(c).isin(*words))
    return df.agg(bad.alias("negative"), r(safe_divide(bad, F.count(F.lit(1)), 100.0)).alias("negative_pct"))


def rating_distribution(df: DataFrame, c: str) -> DataFrame:
    """c, n of each rating, with the mean and median of all."""
    one = with_quantiles(df.agg(r(F.avg(c)).alias("mean")), df, {"median": (c, 0.5)})
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(one))


def value_distribution(df: DataFrame, c: str) -> DataFrame:
    """One row: mean, std, least, most of a column; nulls of the table, and their share of its cells in percent."""
    nulls = sum((F.count_if(F.col(x).isNull()) for x in df.columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(r(F.avg(c)).alias("mean"), r(F.stddev_samp(c)).alias("std"), r(F.min(c)).alias("least"), r(F.max(c)).alias("most"), nulls.alias("nulls"), r(safe_divide(nulls, cells, 100.0)).alias("null_pct"))


def feature_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, missing, missing_pct, mean, std, min, max, skew of numeric columns, from one pass."""
    columns = columns or numeric_columns(df)
    names = ["missing", "missing_pct", "mean", "std", "min", "max", "skew"]

    def measures(c: str) -> list[Column]:
        null = F.count_if(F.col(c).isNull())
        share = r(safe_divide(null, F.count(F.lit(1)), 100.0))
        return [null, share, r(F.avg(c)), r(F.stddev_samp(c)), r(F.min(c).cast("double")), r(F.max(c).cast("double")), r(bias_corrected_skew(c))]

    return _long(df, {c: measures(c) for c in columns}, names)


def describe(df: DataFrame) -> DataFrame:
    """One row per column: count; distinct values, the most frequent one and its number of texts; moments and quartiles of numbers."""
    numbers = numeric_columns(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    shown = ("unique_values", "top", "freq", "mean", "std", "min", "q25", "q50", "q75", "max")
    rows = []
    if numbers:
        quartiles = {f"{i}_{q}": (c, p) for i, c in enumerate(numbers) for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))}
        stats = _long(df, {c: [F.count(c), r(F.avg(c)), r(F.stddev_samp(c)), r(F.min(c).cast("double")), r(F.max(c).cast("double"))] for c in numbers}, ["count", "mean", "std", "min", "max"])
        of = F.array(*[F.struct(F.lit(c).alias("column_name"), *[r(f"{i}_{q}").alias(q) for q in ("q25", "q50", "q75")]) for i, c in enumerate(numbers)])
        rows.append(stats.join(F.broadcast(exact_quantiles(df, quartiles).select(F.inline(of))), "column_name"))
    for c in texts:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_k"))
        best = F.struct(-F.col("_k"), F.col(c))
        rows.append(counts.agg(F.lit(c).alias("column_name"), F.coalesce(F.sum("_k"), F.lit(0)).alias("count"), F.count(F.lit(1)).alias("unique_values"), F.min_by(c, best).alias("top"), F.max("_k").alias("freq")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    kinds = {"top": "string", "unique_values": "bigint", "freq": "bigint"}
    missing = {n: F.lit(None).cast(kinds.get(n, "double")) for n in shown if n not in out.columns}
    return out.withColumns(missing).select("column_name", "count", *shown)


def record_profile(df: DataFrame) -> DataFrame:
    """column_name, type, records, nulls of each column of flattened records."""
    rows = _long(df, {c: [F.lit(df.schema[c].dataType.simpleString()), F.count(F.lit(1)), F.count_if(F.col(c).isNull())] for c in df.columns}, ["type", "records", "nulls"])
    return rows


def report_rows(sections: Mapping[str, DataFrame], limits: Mapping[str, float] | None = None) -> DataFrame:
    """section, key, value, severity: the numbers of one-row summaries; one above its limit is a warning."""
    limits, out = limits or {}, None
    for section, one in sections.items():
        rows = []
        for c in one.columns:
            value = F.col(c).cast("double")
            severity = F.when(value > limits[c], "warning").otherwise("info") if c in limits else F.lit("info")
            rows.append(F.struct(F.lit(section).alias("section"), F.lit(c).alias("key"), value.alias("value"), severity.alias("severity")))
        part = one.select(F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    return out
