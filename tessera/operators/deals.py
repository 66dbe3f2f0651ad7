"""Sales pipeline: stages, forecast, aging, win rate, concentration, anomalies, risks and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.core import clean_text, days_between, parse_number, r, safe_divide, safe_pct, sigma_outliers, top_n_share, with_quantiles

#: Chance of a stage by the first keyword that it contains, in this order.
STAGE_CHANCES = (
    (("closed won", "closed-won", "won", "customer"), 1.0),
    (("closed lost", "closed-lost", "lost", "dead"), 0.0),
    (("proposal", "negotiation", "contract", "verbal", "commit"), 0.70),
    (("demo", "evaluation", "presentation", "qualified"), 0.45),
    (("discovery", "meeting", "contact"), 0.25),
    (("lead", "prospect", "new"), 0.10),
)
OTHER_CHANCE = 0.20


def stage_chance(stage: str | Column) -> Column:
    text = F.lower(clean_text(stage))
    out = F.when(text == "", 0.0)
    for words, chance in STAGE_CHANCES:
        out = out.when(text.rlike("|".join(words)), chance)
    return out.otherwise(OTHER_CHANCE)


def stage_kind(stage: str | Column) -> Column:
    text = F.lower(clean_text(stage))
    return F.when(text.rlike("won|customer"), "won").when(text.rlike("lost|dead"), "lost").otherwise("open")


def prepared(df: DataFrame, amount: str = "amount", stage: str = "stage", probability: str | None = "probability") -> DataFrame:
    """Adds value (0 for none), chance (above 1 counts as percent; else the stage's) and kind."""
    value = F.coalesce(parse_number(amount), F.lit(0.0))
    chance = stage_chance(stage)
    if probability and probability in df.columns:
        p = parse_number(probability)
        chance = F.coalesce(F.least(F.greatest(F.when(p > 1, p / 100).otherwise(p), F.lit(0.0)), F.lit(1.0)), chance)
    return df.withColumns({"value": value, "chance": chance, "kind": stage_kind(stage)})


def deal_quality(df: DataFrame, amount: str = "amount", stage: str = "stage", close: str = "close_date") -> DataFrame:
    """One row: completeness, duplicates, invalid and negative amounts, score, confidence."""
    value = parse_number(amount)
    cells = sum((F.count(F.col(c)) for c in df.columns), F.lit(0))
    one = df.agg(F.count(F.lit(1)).alias("_n"), r(safe_divide(cells, F.count(F.lit(1)) * len(df.columns), 100.0), 2).alias("completeness"), F.count_if(value.isNull() & F.col(amount).isNotNull()).alias("invalid"), F.count_if(value < 0).alias("negative"))
    again = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    one = one.join(again).withColumn("duplicate_pct", safe_pct("duplicates", "_n"))
    score = 100 - F.when(F.col("completeness") < 90, 10).otherwise(0) - F.least("duplicate_pct", F.lit(15.0)) - F.least(2 * F.col("invalid"), F.lit(10)) - F.least(2 * F.col("negative"), F.lit(10))
    absent = (0 if amount in df.columns else 20) + (0 if stage in df.columns else 10) + (0 if close in df.columns else 5)
    sure = F.greatest(F.col("score") - absent, F.lit(0.0))
    return one.withColumn("score", score.cast("double")).withColumn("confidence", F.when(sure >= 80, "high").when(sure >= 60, "medium").otherwise("low")).drop("_n")


def stage_table(df: DataFrame, stage: str = "stage") -> DataFrame:
    key = F.when(clean_text(stage) == "", "Unknown").otherwise(clean_text(stage)).alias("stage")
    return prepared(df, stage=stage).groupBy(key).agg(F.count(F.lit(1)).alias("deals"), r(F.sum("value"), 2).alias("total"), r(F.avg("value")).alias("mean"), F.first("kind").alias("kind"), r(F.avg("chance")).alias("chance"), r(F.sum(F.col("value") * F.col("chance")), 2).alias("weighted"))


def finances(df: DataFrame) -> DataFrame:
    rows = prepared(df)
    one = rows.agg(r(F.sum("value"), 2).alias("total"), r(F.avg("value")).alias("mean"), r(F.max("value"), 2).alias("largest"), r(F.min("value"), 2).alias("smallest"), F.count(F.lit(1)).alias("deals"))
    return with_quantiles(one, rows, {"median": ("value", 0.5)}).withColumn("high_value_from", F.greatest(2 * F.col("median"), "mean"))


def forecast(df: DataFrame) -> DataFrame:
    weighted = F.sum(F.col("value") * F.col("chance"))
    live = F.coalesce(F.sum(F.when(F.col("kind") == "open", F.col("value"))), F.lit(0.0))
    return prepared(df).agg(r(weighted, 2).alias("weighted"), r(weighted * 0.8, 2).alias("conservative"), r(weighted + 0.25 * live, 2).alias("best_case"), r(live, 2).alias("open_amount"))


def aging(df: DataFrame, as_of: Column, created: str = "created_date") -> DataFrame:
    age = F.greatest(days_between(created, as_of), F.lit(0))
    cuts = [(None, 30), (30, 60), (60, 90), (90, 180), (180, None)]
    buckets = [F.count_if((age > lo if lo is not None else F.lit(True)) & (age <= hi if hi is not None else F.lit(True)) & age.isNotNull()).alias(f"days_{lo or 0}_{hi or 'up'}") for lo, hi in cuts]
    one = df.agg(r(F.avg(age)).alias("mean"), F.max(age).alias("oldest"), *buckets, F.count_if(age > 90).alias("stale_90"), F.count_if(age > 180).alias("stale_180"))
    return with_quantiles(one, df, {"median": (age, 0.5)})


def closing(df: DataFrame, as_of: Column, close: str = "close_date", stage: str = "stage") -> DataFrame:
    left, live = days_between(as_of, close), stage_kind(stage) == "open"
    return df.agg(F.count_if(live & (left < 0)).alias("overdue"), F.count_if((left >= 0) & (left <= 7)).alias("next_7"), F.count_if((left >= 0) & (left <= 30)).alias("next_30"), F.count_if(F.col(close).isNull()).alias("missing"))


def win_loss(df: DataFrame, stage: str = "stage") -> DataFrame:
    kind = stage_kind(stage)
    one = df.agg(F.count_if(kind == "won").alias("won"), F.count_if(kind == "lost").alias("lost"))
    return one.withColumn("decided", F.col("won") + F.col("lost")).withColumn("win_pct", safe_pct("won", F.col("won") + F.col("lost")))


def velocity(df: DataFrame, created: str = "created_date", close: str = "close_date") -> DataFrame:
    d = days_between(created, close)
    d = F.when(d >= 0, d)
    one = df.agg(F.count(d).alias("n"), r(F.avg(d)).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"))
    return with_quantiles(one, df, {"median": (d, 0.5)})


def rep_table(df: DataFrame, rep: str = "rep") -> DataFrame:
    return prepared(df).groupBy(F.coalesce(F.col(rep).cast("string"), F.lit("Unknown")).alias("rep")).agg(F.count(F.lit(1)).alias("deals"), r(F.sum("value"), 2).alias("total"), r(F.avg("value")).alias("mean"), F.count_if(F.col("kind") == "won").alias("won"))


def concentration(df: DataFrame) -> DataFrame:
    rows = prepared(df)
    shares = [top_n_share(rows, "value", n).select(r("share", 2).alias(name)) for n, name in ((1, "largest_pct"), (3, "top_3_pct"), (10, "top_10_pct"))]
    one = shares[0].join(shares[1]).join(shares[2])
    return one.withColumn("level", F.when(F.col("largest_pct") >= 30, "high").when(F.col("largest_pct") >= 15, "moderate").otherwise("low"))


def stage_shares(df: DataFrame, stage: str = "stage") -> DataFrame:
    """stage, deals, pct of all deals."""
    per = df.groupBy(stage).agg(F.count(F.lit(1)).alias("deals"))
    return per.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))).select(stage, "deals", safe_pct("deals", "_n").alias("pct"))


def bottlenecks(df: DataFrame, stage: str = "stage") -> DataFrame:
    return stage_shares(df, stage).where("pct >= 40")


def deal_anomalies(df: DataFrame, as_of: Column) -> DataFrame:
    """kind, n: unusual deals, amounts of none, crowded stages, overdue closes."""
    rows = prepared(df)
    count = lambda d, kind: d.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    found = [count(sigma_outliers(rows, "value"), "unusual_amount"), count(rows.where("value <= 0"), "no_amount"), count(stage_shares(df).where("pct >= 60"), "crowded_stage"), closing(df, as_of).select(F.lit("overdue_close").alias("kind"), F.col("overdue").alias("n"))]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.where("n > 0")


def deal_summary(df: DataFrame, as_of: Column) -> DataFrame:
    """One row: deals, pipeline, weighted, win rate, stale, risks, health."""
    one = finances(df).select("deals", "total").join(forecast(df).select("weighted")).join(win_loss(df).select("decided", "win_pct")).join(aging(df, as_of).select("stale_90")).join(concentration(df).select("level")).join(closing(df, as_of).select("overdue"))
    risks = [(F.col("decided") >= 5) & (F.col("win_pct") < 25), F.col("level") == "high", F.col("overdue") > 0, safe_pct("weighted", "total") < 30]
    n = sum((x.cast("int") for x in risks), F.lit(0))
    return one.withColumn("risks", n).withColumn("health", F.when(F.col("risks") >= 3, "at_risk").when(F.col("risks") >= 1, "needs_attention").otherwise("healthy")).drop("decided")


def deal_risks(df: DataFrame, as_of: Column) -> DataFrame:
    """kind, level of each risk that holds."""
    s = deal_summary(df, as_of).join(win_loss(df).select("decided"))
    say = lambda when, kind, level: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level")))
    rows = F.array_compact(F.array(
        say((F.col("decided") >= 5) & (F.col("win_pct") < 25), "low_win_rate", "high"), say(F.col("level") == "high", "pipeline_concentration", "high"),
        say(F.col("overdue") > 0, "overdue_pipeline", "high"), say(safe_pct("weighted", "total") < 30, "low_weighted_pipeline", "medium"),
    ))
    return s.select(F.inline(rows))


def opportunities(df: DataFrame) -> DataFrame:
    """One row: deals from the high-value threshold on, their amount, the open amount."""
    rows = prepared(df).join(F.broadcast(finances(df).select("high_value_from")))
    big = F.col("value") >= F.col("high_value_from")
    return rows.agg(F.count_if(big).alias("high_value"), r(F.coalesce(F.sum(F.when(big, F.col("value"))), F.lit(0.0)), 2).alias("high_value_amount"), r(F.coalesce(F.sum(F.when(F.col("kind") == "open", F.col("value"))), F.lit(0.0)), 2).alias("open_amount"))
