"""Access rights, incidents, stock, licences, logs, projects, service levels, shipments; attendance, churn, reviews, hiring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.core import col, days_between, exact_quantiles, numeric_summary, r, safe_divide, smallest_mode, with_quantiles


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """dimension, label, n: the counts of each column's values, in one pass by grouping sets."""
    out = df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    which, label, width = F.lit(None).cast("string"), F.lit(None).cast("string"), len(columns)
    for i, c in enumerate(columns):
        mask = ((1 << width) - 1) ^ (1 << (width - 1 - i))
        which, label = F.when(F.col("_g") == mask, c).otherwise(which), F.when(F.col("_g") == mask, F.col(c).cast("string")).otherwise(label)
    return out.select(which.alias("dimension"), label.alias("label"), "n").where("label is not null")


def access_review(df: DataFrame, as_of: Column, level: str = "access_level", login: str = "last_login") -> DataFrame:
    """One row: privileged users, users idle for 30 and 90 days, idle administrators."""
    idle, who = days_between(login, as_of), F.lower(level)
    privileged, admin = who.isin("admin", "super_admin", "privileged"), who.isin("admin", "super_admin")
    return df.agg(
        F.count_if(privileged).alias("privileged"), r(safe_divide(F.count_if(privileged), F.count(F.lit(1)), 100.0)).alias("privileged_pct"),
        F.count_if(idle > 30).alias("idle_30"), F.count_if(idle > 90).alias("idle_90"), F.count_if(admin & (idle > 90)).alias("idle_admins"),
    )


def matrix(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of row by column values."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def incidents(df: DataFrame, severity: str = "severity", status: str = "status", hours: str = "time_to_resolve") -> DataFrame:
    live = F.col(status).isin("open", "in_progress")
    one = df.agg(
        F.count_if(live).alias("open"), F.count_if((F.col(severity) == "critical") & live).alias("critical_open"), r(safe_divide(F.count_if(F.col(status) == "escalated"), F.count(F.lit(1)), 100.0)).alias("escalation_rate"),
    )
    return one.join(F.broadcast(numeric_summary(df, hours, ("mean_hours", "median_hours", "min_hours", "max_hours", "std_hours"))))


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def stock(df: DataFrame, on_hand: str = "qty_on_hand", reserved: str = "qty_reserved", reorder: str = "reorder_point", value: str = "value") -> DataFrame:
    low = F.col(on_hand) <= F.col(reorder)
    return df.agg(
        r(F.sum(value), 2).alias("value"), F.sum(on_hand).cast("long").alias("units"), F.sum(reserved).cast("long").alias("reserved"), (F.sum(on_hand) - F.sum(reserved)).cast("long").alias("available"),
        F.count_if(low).alias("low_stock"), F.coalesce(F.sum(F.when(low, F.col(on_hand))), F.lit(0)).cast("long").alias("low_stock_units"),
    )


def abc_classes(df: DataFrame, sku: str = "sku", value: str = "value") -> DataFrame:
    """sku, value, cumulative_pct, class: A up to 80 percent of the value, B up to 95, C beyond; ties by sku.

    The running sum is taken in two steps: within value ranges that Spark deals by sampling, then over the ranges'
    totals, so no task sorts the whole table.
    """
    rows = df.select(sku, F.coalesce(F.col(value), F.lit(0.0)).alias(value))
    parts = rows.repartitionByRange(F.desc(value), F.asc(sku)).withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p").orderBy(F.desc(value), sku).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_run", F.sum(value).over(inside))
    totals = parts.groupBy("_p").agg(F.max("_run").alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_base"), F.sum("_t").over(Window.partitionBy()).alias("_all"))
    share = safe_divide(F.col("_run") + F.col("_base"), "_all", 100.0)
    out = parts.join(F.broadcast(totals), "_p").select(sku, value, r(share).alias("cumulative_pct"))
    return out.withColumn("class", F.when(F.col("cumulative_pct") <= 80, "A").when(F.col("cumulative_pct") <= 95, "B").otherwise("C"))


def stock_flags(df: DataFrame, quantity: str = "qty_on_hand", value: str = "value") -> DataFrame:
    q = exact_quantiles(df, {"high": (value, 0.75), "many": (quantity, 0.75)})
    return df.join(F.broadcast(q)).agg(F.count_if(F.col(value) > F.col("high")).alias("high_value"), F.count_if(F.col(quantity) > F.col("many")).alias("slow_moving"))


def licences(df: DataFrame, as_of: Column, held: str = "quantity_licensed", used: str = "quantity_used", expiry: str = "expiry_date", cost: str = "cost") -> DataFrame:
    """One row: use, over-use, expiry against ``as_of``, cost, verdict."""
    use, left = F.col(used) / (F.col(held) + 1e-4) * 100, days_between(as_of, expiry)
    return df.agg(
        r(F.sum(used) / (F.sum(held) + 1e-4) * 100, 2).alias("utilisation_pct"), F.count_if(use > 100).alias("over_used"), F.count_if(left < 0).alias("expired"),
        F.count_if((left >= 0) & (left <= 30)).alias("expiring"), F.count_if(left > 30).alias("valid"), r(F.sum(cost), 2).alias("total_cost"), r(F.avg(cost)).alias("mean_cost"), r(F.max(cost), 2).alias("max_cost"),
        F.when(F.count_if(use > 100) > 0, "NON_COMPLIANT").otherwise("COMPLIANT").alias("verdict"),
    )


def logs(df: DataFrame, level: str = "level", code: str = "error_code", message: str = "message") -> DataFrame:
    """One row: errors, warnings, error rate, whether above 5 percent, the most frequent error, distinct messages."""
    error = F.upper(level) == "ERROR"
    rate = safe_divide(F.count_if(error), F.count(F.lit(1)), 100.0)
    one = df.agg(F.count_if(error).alias("errors"), F.count_if(F.upper(level) == "WARNING").alias("warnings"), r(rate).alias("error_rate"), F.when(rate > 5, "YES").otherwise("NO").alias("anomaly"), F.count_distinct(message).alias("distinct_messages"))
    return one.join(F.broadcast(smallest_mode(df, F.when(error, F.col(code)), "top_error")))


def counts_by(df: DataFrame, keys: Sequence[str | Column], where: Column | None = None, top: int | None = None) -> DataFrame:
    df = df if where is None else df.where(where)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), *out.columns[:-1]).limit(top) if top else out


def timeline(df: DataFrame, as_of: Column, planned: str = "planned_date", actual: str = "actual_date", status: str = "status", project: str = "project_id") -> DataFrame:
    late = days_between(planned, actual)
    soon = days_between(as_of, planned)
    return df.agg(
        F.count_distinct(project).alias("projects"), F.count(actual).alias("completed"), F.count_if(late <= 0).alias("on_time"), F.count_if(late > 0).alias("delayed"),
        r(F.avg(F.when(late > 0, late))).alias("mean_delay"), F.max(late).alias("max_delay"), r(safe_divide(F.count_if(late <= 0), F.count(actual), 100.0)).alias("on_time_pct"),
        F.count_if(F.col(status) == "at_risk").alias("at_risk"), F.count_if(F.col(status) == "blocked").alias("blocked"), F.count_if((soon >= 0) & (soon <= 30)).alias("upcoming"),
    )


def service_levels(df: DataFrame, target: str = "sla_target", actual: str = "actual_time", by: Sequence[str] = ()) -> DataFrame:
    """Compliant, breached, rate over all rows, near-breaches (above nine tenths, breaches included), response times."""
    ok = F.col(actual) <= F.col(target)
    one = df.groupBy(*by).agg(
        F.count_if(ok).alias("compliant"), F.count_if(F.col(actual) > F.col(target)).alias("breached"), r(safe_divide(F.count_if(ok), F.count(F.lit(1)), 100.0)).alias("rate"),
        F.count_if(F.col(actual) > 0.9 * F.col(target)).alias("at_risk"),
    )
    times = numeric_summary(df, actual, ("mean", "median", "least", "most", "std"), by)
    return one.join(times, list(by)) if by else one.join(F.broadcast(times))


def shipments(df: DataFrame, by: Sequence[str] = (), cost: str = "cost", weight: str = "weight", days: str = "delivery_days", on_time: str = "on_time", top: int | None = None, order: str = "total_cost", ascending: bool = False) -> DataFrame:
    """Number, cost, on-time share, delivery days, weight and cost per weight, of all or per key (the first by ``order``)."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shipments"), r(F.sum(cost), 2).alias("total_cost"), r(F.avg(cost)).alias("mean_cost"), F.count_if(on_time).alias("on_time"), F.count_if(~F.col(on_time)).alias("late"),
        r(safe_divide(F.count_if(on_time), F.count(F.lit(1)), 100.0)).alias("on_time_pct"), r(F.avg(days)).alias("mean_days"), F.min(days).cast("long").alias("min_days"), F.max(days).cast("long").alias("max_days"),
        r(F.sum(weight), 2).alias("total_weight"), r(F.avg(F.col(cost) / (F.col(weight) + 1e-4))).alias("cost_per_weight"),
    )
    return out.orderBy(F.asc(order) if ascending else F.desc(order), *by).limit(top) if top else out


def attendance(df: DataFrame, department: str = "department", employee: str = "employee", status: str = "status") -> DataFrame:
    """Records, present, absent and rate per department and employee, with subtotals and a total (nulls)."""
    s = F.lower(status)
    return df.rollup(department, employee).agg(F.count(F.lit(1)).alias("records"), F.count_if(s == "present").alias("present"), F.count_if(s == "absent").alias("absent"), r(safe_divide(F.count_if(s == "present"), F.count(F.lit(1)), 100.0)).alias("rate"))


def churn(df: DataFrame, status: str = "status", revenue: str = "revenue") -> DataFrame:
    """Per status: sum, mean, number and share of customers, and the churn rate of all."""
    per = df.groupBy(F.lower(status).alias("status")).agg(r(F.sum(revenue), 2).alias("revenue"), r(F.avg(revenue)).alias("mean"), F.count(F.lit(1)).alias("n"))
    rate = df.agg(r(safe_divide(F.count_if(F.lower(status) == "churned"), F.count(F.lit(1)), 100.0)).alias("churn_rate"))
    return per.join(F.broadcast(rate))


def reviews(df: DataFrame, department: str = "department", rating: str = "rating", score: str = "review_score") -> DataFrame:
    per = df.groupBy(department).agg(r(F.avg(score)).alias("mean_score"), F.count(score).alias("n"))
    return per.join(smallest_mode(df, col(rating).cast("long"), "modal_rating", [department]), department, "left")


def review_tiers(df: DataFrame, score: str = "review_score", goals: str = "goals_achieved") -> DataFrame:
    """One row: high from the upper quartile on, middle down to the lower one, low and the low ones' mean; goals."""
    q = df.agg(F.max(goals).alias("most_goals")).join(F.broadcast(exact_quantiles(df, {"lower": (score, 0.25), "upper": (score, 0.75)})))
    s, low = F.col(score), F.col(score) < F.col("lower")
    return df.join(F.broadcast(q)).agg(F.count_if(s >= F.col("upper")).alias("high"), F.count_if((s >= F.col("lower")) & (s < F.col("upper"))).alias("middle"), F.count_if(low).alias("low"), r(F.avg(F.when(low, s))).alias("low_mean"), F.sum(goals).cast("long").alias("goals"), F.count_if(F.col(goals) == F.col("most_goals")).alias("all_goals"))


def recruitment(df: DataFrame, stage: str = "stage", applied: str = "date_applied", hired: str = "date_hired", salary: str = "salary_offered") -> DataFrame:
    wait, s = days_between(applied, hired), F.lower(stage)
    one = df.agg(
        F.count_if(s == "hired").alias("hired"), r(safe_divide(F.count_if(s == "hired"), F.count(F.lit(1)), 100.0)).alias("conversion_pct"), r(safe_divide(F.count_if(s == "rejected"), F.count(F.lit(1)), 100.0)).alias("rejection_pct"),
        r(F.avg(wait)).alias("mean_days"), F.min(wait).alias("min_days"), F.max(wait).alias("max_days"),
        r(F.avg(salary)).alias("mean_salary"), r(F.min(salary), 2).alias("min_salary"), r(F.max(salary), 2).alias("max_salary"),
    )
    return with_quantiles(one, df, {"median_days": (wait, 0.5), "median_salary": (salary, 0.5)})
