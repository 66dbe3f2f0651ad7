"""Receivables, invoices, expenses, budgets, cash, payments, spend and payroll.

Each operator takes a table and the names of its columns, with the usual names as defaults. Times are held against an
explicit ``as_of`` column or literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.core import days_between, iqr_bounds, iqr_outliers, month, r, safe_divide, top_n_share


def receivables(df: DataFrame, amount: str = "amount", paid: str = "amount_paid", days: str = "days_outstanding") -> DataFrame:
    """One row: totals, collection rate, aging buckets, overdue count and amount."""
    d, a = F.col(days), F.col(amount)
    return df.agg(
        r(F.coalesce(F.sum(a), F.lit(0.0)), 2).alias("total_outstanding"), r(F.coalesce(F.sum(paid), F.lit(0.0)), 2).alias("total_paid"),
        r(F.coalesce(F.sum(a), F.lit(0.0)) - F.coalesce(F.sum(paid), F.lit(0.0)), 2).alias("net_outstanding"), r(safe_divide(F.sum(paid), F.sum(a), 100.0)).alias("collection_rate"),
        F.count_if(d <= 30).alias("current"), F.count_if((d > 30) & (d <= 60)).alias("days_31_60"), F.count_if((d > 60) & (d <= 90)).alias("days_61_90"), F.count_if(d > 90).alias("days_over_90"),
        r(F.avg(days)).alias("mean_days"), F.count_if(d > 30).alias("overdue_count"), r(F.coalesce(F.sum(F.when(d > 30, a)), F.lit(0.0)), 2).alias("overdue_amount"),
    )


def customer_receivables(df: DataFrame, customer: str = "customer", amount: str = "amount", paid: str = "amount_paid", top: int = 10) -> DataFrame:
    """The customers that owe most."""
    out = df.groupBy(customer).agg(r(F.sum(amount), 2).alias("amount"), r(F.sum(paid), 2).alias("paid"))
    return out.orderBy(F.desc("amount"), customer).limit(top)


def invoices(df: DataFrame, as_of: Column, amount: str = "amount", paid: str = "amount_paid", status: str = "status", due: str = "date_due") -> DataFrame:
    """One row: counts by state, amounts, paid share, and age against ``as_of`` (nested counts over 30, 60 and 90 days)."""
    late = days_between(due, as_of)
    return df.agg(
        F.count(F.lit(1)).alias("invoices"), F.count_if(F.col(status) == "pending").alias("pending"), F.count_if(F.col(status) == "overdue").alias("overdue"),
        r(F.avg(amount)).alias("mean_amount"), r(F.max(amount), 2).alias("max_amount"), r(F.min(amount), 2).alias("min_amount"),
        r(F.sum(paid), 2).alias("paid"), r(F.sum(amount) - F.sum(paid), 2).alias("outstanding"), r(safe_divide(F.sum(paid), F.sum(amount), 100.0)).alias("paid_pct"),
        r(F.avg(F.when(late > 0, late))).alias("mean_days_overdue"), F.count_if(late > 30).alias("over_30"), F.count_if(late > 60).alias("over_60"), F.count_if(late > 90).alias("over_90"),
    )


def expense_audit(df: DataFrame, amount: str = "amount", description: str = "description", status: str = "status") -> DataFrame:
    """One row: counts by state, quartile outliers with their mean and maximum, rows of repeated descriptions."""
    odd = iqr_outliers(df.select(amount), amount).agg(F.count(F.lit(1)).alias("anomalies"), r(F.avg(amount)).alias("anomaly_mean"), r(F.max(amount), 2).alias("anomaly_max"))
    again = df.where(F.col(description).isNotNull()).groupBy(description).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("possible_duplicates"))
    states = df.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("approved", "pending", "rejected")])
    return states.join(odd).join(again)


def amounts_by(df: DataFrame, key: str, amount: str = "amount", top: int | None = None, by: str = "total") -> DataFrame:
    """Sum, count and mean per key, largest first by total or number."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(r(F.sum(amount), 2).alias("total"), F.count(F.lit(1)).alias("n"), r(F.avg(amount)).alias("mean"))
    return out.orderBy(F.desc(by), key).limit(top) if top else out


def budget_variance(df: DataFrame, budgeted: str = "budgeted", actual: str = "actual") -> DataFrame:
    gap = F.col(actual) - F.col(budgeted)
    return df.agg(
        r(F.sum(budgeted), 2).alias("budgeted"), r(F.sum(actual), 2).alias("actual"), r(F.sum(gap), 2).alias("variance"), r(safe_divide(F.sum(gap), F.sum(budgeted), 100.0)).alias("variance_pct"),
        F.count_if(gap > 0).alias("over_budget"), F.count_if(gap < 0).alias("under_budget"), r(F.avg(safe_divide(gap, budgeted, 100.0))).alias("mean_row_pct"),
    )


def budget_rollup(df: DataFrame, outer: str = "department", inner: str = "category", budgeted: str = "budgeted", actual: str = "actual") -> DataFrame:
    """Variance per department and category, with a subtotal per department and a grand total (nulls)."""
    return df.rollup(outer, inner).agg(r(F.sum(budgeted), 2).alias("budgeted"), r(F.sum(actual), 2).alias("actual"), r(F.sum(F.col(actual) - F.col(budgeted)), 2).alias("variance"), F.count(F.lit(1)).alias("n"))


def cash_flow(df: DataFrame, kind: str = "transaction_type", amount: str = "amount") -> DataFrame:
    flow = lambda k: F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(amount))), F.lit(0.0))
    net = flow("inflow") - flow("outflow")
    return df.agg(r(flow("inflow"), 2).alias("inflow"), r(flow("outflow"), 2).alias("outflow"), r(net, 2).alias("net"), r(safe_divide(net, flow("inflow"), 100.0)).alias("net_pct"), r(F.stddev_samp(amount)).alias("std"), r(F.stddev_samp(amount) / (F.avg(amount) + 1e-4)).alias("variation"))


def monthly(df: DataFrame, ts: str = "date", amount: str = "amount") -> DataFrame:
    return df.groupBy(month(ts).alias("month")).agg(r(F.sum(amount), 2).alias("total"), F.count(F.lit(1)).alias("n"))


def payment_discounts(df: DataFrame, as_of: Column, amount: str = "amount", pct: str = "discount_pct", available: str = "discount_available", due: str = "due_date") -> DataFrame:
    """One row: value of the discounts on offer, and what falls due within 7 and 30 days (overdue included)."""
    left = days_between(as_of, due)
    offer = F.when(F.col(available), F.col(amount) * F.col(pct) / 100)
    return df.agg(
        F.count_if(available).alias("with_discount"), r(F.coalesce(F.sum(offer), F.lit(0.0)), 2).alias("savings"), r(F.avg(F.when(F.col(available), F.col(pct)))).alias("mean_discount_pct"),
        F.count_if(left <= 7).alias("due_7"), F.count_if(left <= 30).alias("due_30"), r(F.avg(left)).alias("mean_days_to_due"),
    )


def vendor_concentration(df: DataFrame, vendor: str = "vendor", amount: str = "amount") -> DataFrame:
    """One row: vendors, total, share of the top 3 and top 10."""
    per = df.groupBy(vendor).agg(F.sum(amount).alias("total"))
    whole = per.agg(F.count(F.lit(1)).alias("vendors"), r(F.sum("total"), 2).alias("total"))
    return whole.join(top_n_share(per, "total", 3).select(r("share").alias("top_3_pct"))).join(top_n_share(per, "total", 10).select(r("share").alias("top_10_pct")))


def category_vendors(df: DataFrame, category: str = "category", vendor: str = "vendor", amount: str = "amount") -> DataFrame:
    return df.groupBy(category).agg(r(F.sum(amount), 2).alias("total"), F.count_distinct(vendor).alias("vendors"))


def payroll(df: DataFrame, department: str = "department", salary: str = "salary") -> DataFrame:
    return df.groupBy(department).agg(F.count(F.lit(1)).alias("employees"), r(F.sum(salary), 2).alias("total"), r(F.avg(salary)).alias("mean"), F.min(salary).alias("least"), F.max(salary).alias("most"))


def payroll_anomalies(df: DataFrame, salary: str = "salary", department: str | None = None) -> DataFrame:
    """Rows beyond the quartile fences of all salaries, or of their department's."""
    if department is None:
        return iqr_outliers(df, salary)
    fences = iqr_bounds(df, salary, [department]).select(department, "low", "high")
    return df.join(fences, department).where((F.col(salary) < F.col("low")) | (F.col(salary) > F.col("high"))).drop("low", "high")


def loan_risk(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Adds risk_score and verdict."""
    score = F.when(F.col(amount) > 50_000, 0.9).otherwise(0.5)
    return df.withColumn("risk_score", score).withColumn("verdict", F.when(F.col("risk_score") > 0.8, "high").otherwise("normal"))
