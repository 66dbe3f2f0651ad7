"""Campaign performance: row metrics, ratios of sums, rankings, efficiency scores, anomalies, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.core import month, r, r_scaled, safe_divide, sigma_outliers, top_n_share, with_pct_ranks, with_quantiles
from tessera.sources.scratch import settled

MEASURES = ("spent", "impressions", "clicks", "conversions", "revenue")


def campaign_quality(df: DataFrame, expected: Sequence[str] = ("campaign_id", "channel", *MEASURES)) -> DataFrame:
    """One row: rows, absent columns, missing share, repeated rows, negative values."""
    have = [c for c in expected if c in df.columns]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in have), F.lit(0))
    negative = sum((F.count_if(F.col(c) < 0) for c in MEASURES if c in have), F.lit(0))
    one = df.agg(F.count(F.lit(1)).alias("row_count"), r(safe_divide(nulls, F.count(F.lit(1)) * len(have), 100.0)).alias("missing_pct"), negative.alias("negatives"))
    again = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    return one.join(again).withColumn("absent_columns", F.lit(len(expected) - len(have)))


def ratios(total: bool) -> dict[str, Column]:
    """The metrics of a row, or of sums over rows."""
    s, i, k, v, e = [F.sum(m) if total else F.col(m) for m in MEASURES]
    return {
        "profit": e - s, "roi_pct": safe_divide(e - s, s, 100.0), "roas": safe_divide(e, s), "margin_pct": safe_divide(e - s, e, 100.0), "ctr_pct": safe_divide(k, i, 100.0), "cpc": safe_divide(s, k),
        "cpm": safe_divide(s, i, 1000.0), "conversion_pct": safe_divide(v, k, 100.0), "cpa": safe_divide(s, v), "revenue_per_click": safe_divide(e, k), "revenue_per_conversion": safe_divide(e, v),
    }


def row_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns(ratios(False))


def campaign_totals(df: DataFrame) -> DataFrame:
    spend = [r(F.avg("spent")).alias("mean_spent"), r(F.max("spent"), 2).alias("max_spent")]
    one = df.agg(F.count(F.lit(1)).alias("campaigns"), *[r(F.sum(m), 2).alias(m) for m in MEASURES], *spend, *[r(c, 2 if n == "profit" else 4).alias(n) for n, c in ratios(True).items()])
    return with_quantiles(one, df, {"median_spent": ("spent", 0.5)})


def channel_table(df: DataFrame, channel: str = "channel") -> DataFrame:
    """The same per channel; no channel is "Unknown"."""
    key = F.coalesce(F.col(channel), F.lit("Unknown")).alias("channel")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("campaigns"), *[r(F.sum(m), 2).alias(m) for m in MEASURES], *[r(c, 2 if n == "profit" else 4).alias(n) for n, c in ratios(True).items()])


def best_channels(df: DataFrame) -> DataFrame:
    """One row: the channels best by return, conversion and profit; the smaller name of equals."""
    best = lambda m: F.min_by("channel", F.struct(-F.col(m), "channel"))
    return channel_table(df).agg(best("roas").alias("by_roas"), best("conversion_pct").alias("by_conversion"), best("profit").alias("by_profit"))


def top_bottom(df: DataFrame, key: str = "campaign_id", n: int = 5) -> DataFrame:
    """The n best and n worst campaigns by return on spend: side, key, roas."""
    rows = row_metrics(df).select(key, r("roas").alias("roas"))
    top = rows.orderBy(F.desc("roas"), key).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(rows.orderBy(F.asc("roas"), key).limit(n).withColumn("side", F.lit("bottom")))


def underperformers(df: DataFrame, key: str = "campaign_id") -> DataFrame:
    """Campaigns with a reason to look at them, and the reasons."""
    loss = F.when(F.col("revenue") < F.col("spent"), "revenue below spend")
    idle = F.when((F.col("spent") > 0) & (F.col("conversions") == 0), "spend without conversions")
    weak = F.when(safe_divide("revenue", "spent") < 1, "return below one")
    why = F.array_compact(F.array(loss, idle, weak))
    return df.select(key, "spent", "revenue", F.array_join(why, "; ").alias("reasons")).where("reasons != ''")


def budget_concentration(df: DataFrame) -> DataFrame:
    return top_n_share(df, "spent", 5).select(r("share").alias("top_5_pct")).join(top_n_share(df, "spent", 1).select(r("share").alias("largest_pct")))


def efficiency(df: DataFrame, key: str = "campaign_id") -> DataFrame:
    """Score of 0 to 100 from ranks: return 40, conversion 30, clicks 15, cost per conversion 15 (lower is better).

    A rank is weighed before it is divided, and the sum is rounded by its product: many scores lie half way between two of four places.
    """
    measures = (F.col("roas"), F.col("conversion_pct"), F.col("ctr_pct"), -F.col("cpa"))
    rows = row_metrics(df).select(key, "roas", "conversion_pct", "ctr_pct", "cpa")
    rows = settled(rows.withColumn("_row", F.monotonically_increasing_id()))  # read again for the ranks
    each = F.array(*[F.struct(F.lit(i).alias("_m"), m.cast("double").alias("_v")) for i, m in enumerate(measures)])
    long = rows.select(key, "_row", F.inline(each))
    weight = F.element_at(F.array(*[F.lit(w) for w in (40, 30, 15, 15)]), F.col("_m") + 1)
    ranked = with_pct_ranks(long, {"_p": F.col("_v")}, ["_m"], weight)
    wide = ranked.groupBy("_row", key).agg(*[F.max(F.when(F.col("_m") == i, F.col("_p"))).alias(f"_{i}") for i in range(len(measures))])
    score = F.col("_0") + F.col("_1") + F.col("_2") + F.col("_3")
    return wide.select(key, r_scaled(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))).alias("score"))


def campaign_anomalies(df: DataFrame, key: str = "campaign_id") -> DataFrame:
    """Spend or conversion rate above mean + 2 std: measure, key, value."""
    rows = row_metrics(df)
    found = [sigma_outliers(rows, m).select(F.lit(m).alias("measure"), key, r(m).alias("value")) for m in ("spent", "conversion_pct")]
    return found[0].unionByName(found[1])


def campaign_trend(df: DataFrame, ts: str = "date") -> DataFrame:
    keep = ("ctr_pct", "conversion_pct", "roas")
    return df.groupBy(month(ts).alias("month")).agg(*[r(F.sum(m), 2).alias(m) for m in MEASURES], *[r(c).alias(n) for n, c in ratios(True).items() if n in keep])


def campaign_findings(df: DataFrame, key: str = "campaign_id") -> DataFrame:
    """Findings as rows: kind, level, detail."""
    one = campaign_totals(df).select("roi_pct", "roas").join(budget_concentration(df)).join(best_channels(df).select("by_roas"))
    one = one.join(df.agg(F.count_if((F.col("spent") > 0) & (F.col("conversions") == 0)).alias("idle"))).join(campaign_anomalies(df, key).agg(F.count(F.lit(1)).alias("odd")))
    say = lambda when, kind, level, text: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), text.alias("detail")))
    rows = F.array_compact(F.array(
        say(F.col("idle") > 0, "zero_conversion", "high", F.format_string("%d campaigns spend without conversions", "idle")),
        say(F.col("roi_pct") < 0, "negative_roi", "high", F.format_string("return on investment is %.2f percent", "roi_pct")),
        say(F.col("top_5_pct") >= 60, "budget_concentration", "medium", F.format_string("five campaigns hold %.2f percent of the spend", "top_5_pct")),
        say(F.col("by_roas").isNotNull(), "best_channel", "info", F.format_string("best channel by return: %s", "by_roas")),
        say(F.col("odd") > 0, "anomalies", "medium", F.format_string("%d unusual values", "odd")),
    ))
    return one.select(F.inline(rows))


def latest(df: DataFrame, by: Sequence[str], ts: str, n: int) -> DataFrame:
    """The n latest rows of each key."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(ts)))).where(F.col("_i") <= n).drop("_i")
