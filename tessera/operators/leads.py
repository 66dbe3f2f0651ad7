"""Leads: status, funnel, value, sources, aging, scores, conversion, companies, anomalies, trend and forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.core import exact_quantiles, map_label, month, r, safe_divide_eps, sigma_outliers, top_n_share, with_quantiles

#: Points of a status, order of the funnel, states that end a lead.
STATUS_POINTS = {"converted": 100, "opportunity": 90, "qualified": 80, "working": 65, "contacted": 55, "prospect": 45, "new": 40, "nurture": 30, "unknown": 20, "lost": 10, "disqualified": 5}
FUNNEL = ("new", "prospect", "contacted", "working", "qualified", "opportunity", "converted", "lost", "disqualified", "nurture", "unknown")
TERMINAL = ("converted", "lost", "disqualified")
ACTIVE = ("new", "prospect", "contacted", "working", "qualified", "opportunity", "nurture")
REACHED = ("qualified", "opportunity", "converted")


def prepared(df: DataFrame, status: str = "status", value: str = "value") -> DataFrame:
    return df.withColumns({"state": map_label(status), "worth": F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))})


def rate(num: Column, den: Column) -> Column:
    return r(safe_divide_eps(num * 100.0, den), 4)


def is_(*states: str) -> Column:
    return F.col("state").isin(*states)


def lead_quality(df: DataFrame, lead_id: str = "lead_id", value: str = "value", age: str = "age_days") -> DataFrame:
    again = df.where(F.col(lead_id).isNotNull()).groupBy(lead_id).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("duplicate_ids"))
    rows = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    one = df.agg(F.count(F.lit(1)).alias("leads"), rate(nulls, F.count(F.lit(1)) * len(df.columns)).alias("missing_pct"), F.count_if(F.col(value) < 0).alias("negative_value"), F.count_if(F.col(age) < 0).alias("negative_age"))
    return one.join(again).join(rows)


def statuses(df: DataFrame) -> DataFrame:
    return prepared(df).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def funnel(df: DataFrame) -> DataFrame:
    """state, position, n, pct: in the funnel's order, other states after it by name."""
    order = F.array(*[F.lit(s) for s in FUNNEL])
    per = statuses(df).withColumn("_p", F.array_position(order, F.col("state")))
    whole = F.sum("n").over(Window.partitionBy())
    return per.select("state", F.when(F.col("_p") == 0, 99).otherwise(F.col("_p")).cast("long").alias("position"), "n", rate(F.col("n").cast("double"), whole).alias("pct"))


def value_summary(df: DataFrame) -> DataFrame:
    rows = prepared(df)
    q = exact_quantiles(rows, {"p50": ("worth", 0.5), "p75": ("worth", 0.75), "p90": ("worth", 0.9)})
    w = F.col("worth")
    return rows.join(F.broadcast(q)).agg(
        r(F.sum(w), 2).alias("total"), r(F.avg(w)).alias("mean"), r(F.max("p50")).alias("median"), r(F.max(w), 2).alias("largest"), r(F.max("p75")).alias("p75"), r(F.max("p90")).alias("p90"),
        F.count_if(w >= F.col("p75")).alias("high"), F.count_if(w >= F.col("p90")).alias("very_high"), rate(F.sum(F.when(w >= F.col("p75"), w)), F.sum(w)).alias("high_share"), F.count_if(w == 0).alias("zero"), F.count_if(w > 0).alias("positive"),
    )


def performance(df: DataFrame, key: str) -> DataFrame:
    """Per source, stage or company: leads, reached, converted, lost, value and rates."""
    n = F.count(F.lit(1))
    return prepared(df).groupBy(F.coalesce(F.col(key).cast("string"), F.lit("Unknown")).alias(key)).agg(
        n.alias("leads"), F.count_if(is_(*REACHED)).alias("qualified"), F.count_if(is_("converted")).alias("converted"), F.count_if(is_("lost")).alias("lost"), r(F.sum("worth"), 2).alias("value"), r(F.avg("worth")).alias("mean_value"),
        rate(F.count_if(is_("converted")), n).alias("conversion_pct"), rate(F.count_if(is_(*REACHED)), n).alias("qualification_pct"),
    )


def best_sources(df: DataFrame, key: str = "source") -> DataFrame:
    best = lambda m: F.min_by(key, F.struct(-F.col(m), key))
    return performance(df, key).agg(best("conversion_pct").alias("by_conversion"), best("value").alias("by_value"), best("qualification_pct").alias("by_quality"))


def lead_aging(df: DataFrame, age: str = "age_days") -> DataFrame:
    a, live = F.col(age).try_cast("double"), ~is_(*TERMINAL)
    stale = live & (a >= 60)
    one = prepared(df).agg(
        r(F.avg(a)).alias("mean"), r(F.max(a)).alias("oldest"), F.count_if(a > 30).alias("over_30"), F.count_if(a > 60).alias("over_60"), F.count_if(a > 90).alias("over_90"),
        F.count_if(stale).alias("stale"), F.count_if(live & (a >= 90)).alias("critical"), rate(F.coalesce(F.sum(F.when(stale, F.col("worth"))), F.lit(0.0)), F.sum("worth")).alias("stale_value_pct"),
    )
    return with_quantiles(one, df, {"median": (a, 0.5)})


def lead_scores(df: DataFrame, age: str = "age_days") -> DataFrame:
    """Adds score (0 to 100) and band: value, status points, freshness, and twenty for qualified leads and opportunities."""
    rows = prepared(df)
    most = rows.agg(F.max("worth").alias("_most"))
    points = F.create_map(*[F.lit(x) for pair in STATUS_POINTS.items() for x in pair])
    old = F.least(F.greatest(F.coalesce(F.col(age).try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(120.0))
    raw = 40 * safe_divide_eps("worth", "_most") + 0.4 * F.coalesce(F.try_element_at(points, "state"), F.lit(20)) + (20 - old / 6) + F.when(is_("qualified", "opportunity"), 20).otherwise(0)
    out = rows.join(F.broadcast(most)).withColumn("score", r(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)))).drop("_most")
    s = F.col("score")
    return out.withColumn("band", F.when(s >= 85, "hot").when(s >= 70, "warm").when(s >= 50, "medium").otherwise("cold"))


def conversion(df: DataFrame) -> DataFrame:
    n, won, lost = F.count(F.lit(1)), F.count_if(is_("converted")), F.count_if(is_("lost"))
    return prepared(df).agg(
        rate(won, n).alias("conversion_pct"), rate(F.count_if(is_(*REACHED)), n).alias("qualification_pct"), rate(won, F.count_if(is_(*REACHED))).alias("qualified_to_converted"),
        rate(won, won + lost).alias("win_pct"), rate(lost, n).alias("loss_pct"), F.count_if(is_(*ACTIVE)).alias("active"),
    )


def lead_concentration(df: DataFrame, source: str = "source") -> DataFrame:
    rows = prepared(df)
    per = rows.groupBy(source).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = top_n_share(rows, "worth", 5).select(r("share").alias("top_5_pct")).join(top_n_share(per, "n", 1).select(r("share").alias("top_source_pct")))
    s = F.col("top_source_pct")
    return one.withColumn("level", F.when(s >= 60, "high").when(s >= 40, "medium").otherwise("low"))


def lead_anomalies(df: DataFrame, lead_id: str = "lead_id", age: str = "age_days", most: int = 20) -> DataFrame:
    """kind, lead_id, amount: at most ``most`` of each kind, largest first."""
    rows = prepared(df).withColumn("_age", F.col(age).try_cast("double"))
    odd = sigma_outliers(rows, "worth").select(F.lit("value").alias("kind"), lead_id, F.col("worth").alias("amount"))
    limit = rows.agg(F.greatest(F.lit(90.0), F.avg("_age") + 2 * F.coalesce(F.stddev_samp("_age"), F.lit(0.0))).alias("_limit"))
    old = rows.join(F.broadcast(limit)).where("_age > _limit").select(F.lit("age").alias("kind"), lead_id, F.col("_age").alias("amount"))
    gone = rows.where(is_("lost", "disqualified") & (F.col("worth") > 0)).select(F.lit("value_on_lost").alias("kind"), lead_id, F.col("worth").alias("amount"))
    parts = [d.orderBy(F.desc("amount"), lead_id).limit(most) for d in (odd, old, gone)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("amount", r("amount", 2))


def lead_trend(df: DataFrame, ts: str = "date") -> DataFrame:
    """month, leads, converted, value, conversion_pct, change_pct against the month before."""
    per = prepared(df).where(F.col(ts).isNotNull()).groupBy(month(ts).alias("month")).agg(F.count(F.lit(1)).alias("leads"), F.count_if(is_("converted")).alias("converted"), r(F.sum("worth"), 2).alias("value"))
    before = F.lag("leads").over(Window.orderBy("month"))
    return per.select("month", "leads", "converted", "value", rate(F.col("converted"), F.col("leads")).alias("conversion_pct"), rate((F.col("leads") - before).cast("double"), before.cast("double")).alias("change_pct"))


def lead_forecast(df: DataFrame, ts: str = "date", months: int = 3) -> DataFrame:
    """One row if there are ``months`` months: mean leads and conversion of the last ones, expected conversions."""
    last = lead_trend(df, ts).orderBy(F.desc("month")).limit(months)
    one = last.agg(F.count(F.lit(1)).alias("_n"), r(F.avg("leads")).alias("mean_leads"), r(F.avg("conversion_pct")).alias("mean_conversion"), r(F.avg("leads") * F.avg("conversion_pct") / 100).alias("expected"))
    return one.where(F.col("_n") >= months).drop("_n")
