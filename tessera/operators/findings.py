"""Findings: rules over a row of metrics, as rows of scope, kind, level and the metric that fired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.core import safe_pct
from tessera.operators import campaigns as ca
from tessera.operators import deals as de
from tessera.operators import leads as le

Rule = tuple[str, str, str, Column, Column]


def findings(metrics: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """scope, kind, level, value of every rule (scope, kind, level, condition, value) that holds on the one row of metrics."""
    made = [F.when(when, F.struct(F.lit(s).alias("scope"), F.lit(k).alias("kind"), F.lit(v).alias("level"), x.cast("double").alias("value"))) for s, k, v, when, x in rules]
    return metrics.select(F.inline(F.array_compact(F.array(*made))))


def deal_metrics(df: DataFrame, as_of: Column) -> DataFrame:
    one = de.deal_summary(df, as_of).join(de.win_loss(df).select("decided")).join(de.opportunities(df)).join(de.concentration(df).select("largest_pct"))
    return one.join(de.bottlenecks(df).agg(F.count(F.lit(1)).alias("bottlenecks"))).join(de.deal_anomalies(df, as_of).agg(F.count(F.lit(1)).alias("anomalies")))


def deal_findings(df: DataFrame, as_of: Column) -> DataFrame:
    c, share = F.col, safe_pct("weighted", "total")
    return findings(deal_metrics(df, as_of), [
        ("risk", "low_win_rate", "high", (c("decided") >= 5) & (c("win_pct") < 25), c("win_pct")),
        ("risk", "pipeline_concentration", "high", c("level") == "high", c("largest_pct")),
        ("risk", "overdue_pipeline", "high", c("overdue") > 0, c("overdue")),
        ("risk", "low_weighted_pipeline", "medium", share < 30, share),
        ("opportunity", "high_value_opportunities", "info", c("high_value") > 0, c("high_value")),
        ("opportunity", "open_pipeline", "info", c("open_amount") > 0, c("open_amount")),
        ("action", "bottleneck", "medium", c("bottlenecks") > 0, c("bottlenecks")),
        ("action", "anomaly_review", "medium", c("anomalies") > 0, c("anomalies")),
    ])


def lead_metrics(df: DataFrame) -> DataFrame:
    one = le.conversion(df).select("conversion_pct").join(le.lead_aging(df).select("stale", "critical")).join(le.value_summary(df).select("high")).join(le.lead_concentration(df).select("level", "top_source_pct"))
    q = le.lead_quality(df)
    warnings = (F.col("missing_pct") > 0).cast("int") + (F.col("duplicate_ids") > 0).cast("int") + (F.col("duplicate_rows") > 0).cast("int") + (F.col("negative_value") > 0).cast("int") + (F.col("negative_age") > 0).cast("int")
    one = one.join(q.select(warnings.alias("warnings"))).join(le.lead_anomalies(df).agg(F.count(F.lit(1)).alias("anomalies"))).join(le.best_sources(df).select("by_conversion"))
    return one.withColumn("confidence", F.when(F.col("warnings") == 0, "high").when(F.col("warnings") <= 2, "medium").otherwise("low"))


def lead_findings(df: DataFrame) -> DataFrame:
    c = F.col
    return findings(lead_metrics(df), [
        ("risk", "lead_aging", "high", c("critical") > 0, c("critical")),
        ("risk", "source_concentration", "high", c("level") == "high", c("top_source_pct")),
        ("risk", "data_or_pipeline_anomalies", "medium", c("anomalies") > 0, c("anomalies")),
        ("risk", "data_quality", "medium", c("warnings") > 0, c("warnings")),
        ("risk", "low_conversion", "high", c("conversion_pct") < 5, c("conversion_pct")),
        ("opportunity", "high_performing_source", "medium", c("by_conversion").isNotNull(), F.lit(1)),
        ("opportunity", "high_value_leads", "high", c("high") > 0, c("high")),
        ("action", "lead_aging", "high", c("stale") > 0, c("stale")),
        ("action", "lead_prioritization", "high", c("high") > 0, c("high")),
        ("action", "conversion", "high", c("conversion_pct") < 5, c("conversion_pct")),
        ("action", "source_diversification", "high", c("level") == "high", c("top_source_pct")),
        ("action", "anomaly_review", "medium", c("anomalies") > 0, c("anomalies")),
        ("action", "immediate_sales_action", "critical", c("critical") > 0, c("critical")),
    ])


def campaign_actions(df: DataFrame, key: str = "campaign_id") -> DataFrame:
    c = F.col
    one = df.agg(F.count_if((c("spent") > 0) & (c("conversions") == 0)).alias("idle")).join(ca.underperformers(df, key).agg(F.count(F.lit(1)).alias("weak"))).join(ca.budget_concentration(df)).join(ca.campaign_anomalies(df, key).agg(F.count(F.lit(1)).alias("odd")))
    return findings(one, [
        ("action", "conversion", "high", c("idle") > 0, c("idle")),
        ("action", "roi", "high", c("weak") > 0, c("weak")),
        ("action", "budget_risk", "medium", c("top_5_pct") >= 60, c("top_5_pct")),
        ("action", "data_and_performance", "medium", c("odd") > 0, c("odd")),
    ])


def label_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """dimension, label, n of several columns; null and blank are "Unknown"."""
    from tessera.operators.operations import distributions

    named = df.select(*[F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("Unknown")).alias(c) for c in columns])
    return distributions(named, columns)
