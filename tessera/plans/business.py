"""Queries of finance, operations and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import finance as fi
from tessera.operators import operations as op
from tessera.plans.common import AS_OF_SQL, Catalog, as_of

C = Catalog()
DAYS = "floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0)::BIGINT"


def days(a: str, b: str) -> str:
    return DAYS.format(a=a, b=b)


def pct(num: str, den: str) -> str:
    return f"round(CASE WHEN {den} = 0 THEN 0.0 ELSE ({num}) * 100.0 / ({den}) END, 4)"


def cnt(when: str) -> str:
    return f"count(*) FILTER (WHERE {when})"


C.over("f01_receivables", "receivables", fi.receivables, f"""SELECT round(sum(amount), 2) AS total_outstanding, round(sum(amount_paid), 2) AS total_paid, round(sum(amount) - sum(amount_paid), 2) AS net_outstanding,
 round(sum(amount_paid) * 100.0 / sum(amount), 4) AS collection_rate, {cnt('days_outstanding <= 30')} AS current, {cnt('days_outstanding > 30 AND days_outstanding <= 60')} AS days_31_60,
 {cnt('days_outstanding > 60 AND days_outstanding <= 90')} AS days_61_90, {cnt('days_outstanding > 90')} AS days_over_90, round(avg(days_outstanding), 4) AS mean_days,
 {cnt('days_outstanding > 30')} AS overdue_count, round(sum(amount) FILTER (WHERE days_outstanding > 30), 2) AS overdue_amount FROM v""")
C.over("f03_customer_receivables", "receivables", fi.customer_receivables, "SELECT customer, round(sum(amount), 2) AS amount, round(sum(amount_paid), 2) AS paid FROM v GROUP BY customer ORDER BY amount DESC, customer LIMIT 10")
C.over("f08_invoices", "receivables", lambda d: fi.invoices(d, as_of()), f"""SELECT count(*) AS invoices, {cnt("status = 'pending'")} AS pending, {cnt("status = 'overdue'")} AS overdue, round(avg(amount), 4) AS mean_amount, round(max(amount), 2) AS max_amount, round(min(amount), 2) AS min_amount,
 round(sum(amount_paid), 2) AS paid, round(sum(amount) - sum(amount_paid), 2) AS outstanding, round(sum(amount_paid) * 100.0 / sum(amount), 4) AS paid_pct, round(avg(late) FILTER (WHERE late > 0), 4) AS mean_days_overdue,
 {cnt('late > 30')} AS over_30, {cnt('late > 60')} AS over_60, {cnt('late > 90')} AS over_90 FROM (SELECT *, {days('date_due', AS_OF_SQL)} AS late FROM v)""")
C.over("f05_invoice_states", "receivables", lambda d: op.counts_by(d, ["status"]), "SELECT status, count(*) AS n FROM v GROUP BY status")
C.over("f10_expense_audit", "expenses", fi.expense_audit, f""", q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM v), o AS (SELECT amount FROM v, q WHERE amount < a - 1.5 * (b - a) OR amount > b + 1.5 * (b - a))
 SELECT {cnt("status = 'approved'")} AS approved, {cnt("status = 'pending'")} AS pending, {cnt("status = 'rejected'")} AS rejected, (SELECT count(*) FROM o) AS anomalies, (SELECT round(avg(amount), 4) FROM o) AS anomaly_mean, (SELECT round(max(amount), 2) FROM o) AS anomaly_max,
 (SELECT coalesce(sum(k), 0)::BIGINT FROM (SELECT count(*) AS k FROM v GROUP BY description HAVING count(*) > 1)) AS possible_duplicates FROM v""")
C.over("f11_top_spenders", "expenses", lambda d: fi.amounts_by(d, "employee", top=10, by="n"), "SELECT employee, round(sum(amount), 2) AS total, count(*) AS n, round(avg(amount), 4) AS mean FROM v GROUP BY employee ORDER BY n DESC, employee LIMIT 10")
C.over("f12_expense_categories", "expenses", lambda d: fi.amounts_by(d, "category"), "SELECT category, round(sum(amount), 2) AS total, count(*) AS n, round(avg(amount), 4) AS mean FROM v GROUP BY category")
C.over("f14_budget_variance", "budget", fi.budget_variance, f"""SELECT round(sum(budgeted), 2) AS budgeted, round(sum(actual), 2) AS actual, round(sum(actual - budgeted), 2) AS variance, round(sum(actual - budgeted) * 100.0 / sum(budgeted), 4) AS variance_pct,
 {cnt('actual > budgeted')} AS over_budget, {cnt('actual < budgeted')} AS under_budget, round(avg(CASE WHEN budgeted = 0 THEN 0 ELSE (actual - budgeted) * 100.0 / budgeted END), 4) AS mean_row_pct FROM v""")
C.over("f15_budget_rollup", "budget", fi.budget_rollup, "SELECT department, category, round(sum(budgeted), 2) AS budgeted, round(sum(actual), 2) AS actual, round(sum(actual - budgeted), 2) AS variance, count(*) AS n FROM v GROUP BY ROLLUP (department, category)")
C.over("f17_cash_flow", "cash", fi.cash_flow, """SELECT round(i, 2) AS inflow, round(o, 2) AS outflow, round(i - o, 2) AS net, round(CASE WHEN i = 0 THEN 0 ELSE (i - o) * 100.0 / i END, 4) AS net_pct, round(s, 4) AS std, round(s / (m + 1e-4), 4) AS variation
 FROM (SELECT sum(amount) FILTER (WHERE transaction_type = 'inflow') AS i, sum(amount) FILTER (WHERE transaction_type = 'outflow') AS o, stddev_samp(amount) AS s, avg(amount) AS m FROM v)""")
C.over("f18_cash_categories", "cash", lambda d: fi.amounts_by(d, "category"), "SELECT category, round(sum(amount), 2) AS total, count(*) AS n, round(avg(amount), 4) AS mean FROM v GROUP BY category")
C.over("f19_monthly_expenses", "expenses", fi.monthly, "SELECT strftime(date, '%Y-%m') AS month, round(sum(amount), 2) AS total, count(*) AS n FROM v GROUP BY 1")
C.over("f21_payment_discounts", "payments", lambda d: fi.payment_discounts(d, as_of()), f"""SELECT {cnt('discount_available')} AS with_discount, round(sum(amount * discount_pct / 100) FILTER (WHERE discount_available), 2) AS savings, round(avg(discount_pct) FILTER (WHERE discount_available), 4) AS mean_discount_pct,
 {cnt('l <= 7')} AS due_7, {cnt('l <= 30')} AS due_30, round(avg(l), 4) AS mean_days_to_due FROM (SELECT *, {days(AS_OF_SQL, 'due_date')} AS l FROM v)""")
C.over("f22_payment_terms", "payments", lambda d: op.counts_by(d, ["terms"]), "SELECT terms, count(*) AS n FROM v GROUP BY terms")
C.over("f24_vendor_spend", "spend", lambda d: fi.amounts_by(d, "vendor", top=10), "SELECT vendor, round(sum(amount), 2) AS total, count(*) AS n, round(avg(amount), 4) AS mean FROM v GROUP BY vendor ORDER BY total DESC, vendor LIMIT 10")
C.over("f25_vendor_concentration", "spend", fi.vendor_concentration, """SELECT count(*) AS vendors, round(sum(t), 2) AS total, round(sum(t) FILTER (WHERE i <= 3) * 100.0 / sum(t), 4) AS top_3_pct, round(sum(t) FILTER (WHERE i <= 10) * 100.0 / sum(t), 4) AS top_10_pct
 FROM (SELECT vendor, sum(amount) AS t, row_number() OVER (ORDER BY sum(amount) DESC) AS i FROM v GROUP BY vendor)""")
C.over("f26_category_vendors", "spend", fi.category_vendors, "SELECT category, round(sum(amount), 2) AS total, count(DISTINCT vendor) AS vendors FROM v GROUP BY category")
C.over("f27_spend_terms", "spend", lambda d: op.distributions(d, ["payment_terms", "category"]), "SELECT 'payment_terms' AS dimension, payment_terms AS label, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM v GROUP BY 2")
C.over("f28_payroll", "staff", fi.payroll, "SELECT department, count(*) AS employees, round(sum(salary), 2) AS total, round(avg(salary), 4) AS mean, min(salary) AS least, max(salary) AS most FROM v GROUP BY department")
C.over("f29_payroll_anomalies", "staff", lambda d: fi.payroll_anomalies(d, department="department"), """SELECT department, employee, salary FROM v JOIN (SELECT department, quantile_cont(salary, 0.25) AS a, quantile_cont(salary, 0.75) AS b FROM v GROUP BY department) USING (department)
 WHERE salary < a - 1.5 * (b - a) OR salary > b + 1.5 * (b - a)""")
C.over("f30_loan_risk", "receivables", lambda d: fi.loan_risk(d.select("invoice_id", "amount")), "SELECT invoice_id, amount, CASE WHEN amount > 50000 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS risk_score, CASE WHEN amount > 50000 THEN 'high' ELSE 'normal' END AS verdict FROM v")
C.over("o01_access_distributions", "access", lambda d: op.distributions(d, ["role", "access_level", "department"]), "SELECT 'role' AS dimension, role AS label, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'access_level', access_level, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'department', department, count(*) FROM v GROUP BY 2")
C.over("o02_access_review", "access", lambda d: op.access_review(d, as_of()), f"""SELECT {cnt('p')} AS privileged, {pct(cnt('p'), 'count(*)')} AS privileged_pct, {cnt('i > 30')} AS idle_30, {cnt('i > 90')} AS idle_90, {cnt('p AND i > 90')} AS idle_admins
 FROM (SELECT access_level IN ('admin', 'super_admin') AS p, {days('last_login', AS_OF_SQL)} AS i FROM v)""")
C.over("o05_access_matrix", "access", lambda d: op.matrix(d, "role", "access_level", ["admin", "super_admin", "user"]), f"""SELECT role, {cnt("access_level = 'admin'")} AS admin, {cnt("access_level = 'super_admin'")} AS super_admin, {cnt("access_level = 'user'")} AS "user" FROM v GROUP BY role""")
C.over("o06_incident_distributions", "incidents", lambda d: op.distributions(d, ["severity", "status", "category"]), "SELECT 'severity' AS dimension, severity AS label, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM v GROUP BY 2")
C.over("o07_incidents", "incidents", op.incidents, f"""SELECT {cnt("status IN ('open', 'in_progress')")} AS open, {cnt("severity = 'critical' AND status IN ('open', 'in_progress')")} AS critical_open, {pct(cnt("status = 'escalated'"), 'count(*)')} AS escalation_rate,
 round(avg(time_to_resolve), 4) AS mean_hours, round(median(time_to_resolve), 4) AS median_hours, round(min(time_to_resolve), 4) AS min_hours, round(max(time_to_resolve), 4) AS max_hours, round(stddev_samp(time_to_resolve), 4) AS std_hours FROM v""")
C.over("o08_daily_incidents", "incidents", lambda d: op.daily_counts(d, "reported_date"), "SELECT strftime(reported_date, '%Y-%m-%d') AS day, count(*) AS n FROM v GROUP BY 1")
C.over("o11_stock", "stock", op.stock, f"SELECT round(sum(value), 2) AS value, sum(qty_on_hand)::BIGINT AS units, sum(qty_reserved)::BIGINT AS reserved, (sum(qty_on_hand) - sum(qty_reserved))::BIGINT AS available, {cnt('qty_on_hand <= reorder_point')} AS low_stock, coalesce(sum(qty_on_hand) FILTER (WHERE qty_on_hand <= reorder_point), 0)::BIGINT AS low_stock_units FROM v")
C.over("o14_abc_classes", "stock", op.abc_classes, """SELECT sku, value, p AS cumulative_pct, CASE WHEN p <= 80 THEN 'A' WHEN p <= 95 THEN 'B' ELSE 'C' END AS class
 FROM (SELECT sku, value, round(sum(value) OVER (ORDER BY value DESC, sku ROWS UNBOUNDED PRECEDING) * 100.0 / sum(value) OVER (), 4) AS p FROM v)""")
C.over("o15_stock_flags", "stock", op.stock_flags, f"SELECT {cnt('value > a')} AS high_value, {cnt('qty_on_hand > b')} AS slow_moving FROM v, (SELECT quantile_cont(value, 0.75) AS a, quantile_cont(qty_on_hand::DOUBLE, 0.75) AS b FROM v)")
C.over("o16_licences", "licences", lambda d: op.licences(d, as_of()), f"""SELECT round(sum(quantity_used) / (sum(quantity_licensed) + 1e-4) * 100, 2) AS utilisation_pct, {cnt('u > 100')} AS over_used, {cnt('l < 0')} AS expired, {cnt('l >= 0 AND l <= 30')} AS expiring, {cnt('l > 30')} AS valid,
 round(sum(cost), 2) AS total_cost, round(avg(cost), 4) AS mean_cost, round(max(cost), 2) AS max_cost, CASE WHEN {cnt('u > 100')} > 0 THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS verdict
 FROM (SELECT *, quantity_used / (quantity_licensed + 1e-4) * 100 AS u, {days(AS_OF_SQL, 'expiry_date')} AS l FROM v)""")
C.over("o18_licence_cost", "licences", lambda d: fi.amounts_by(d, "software", "cost"), "SELECT software, round(sum(cost), 2) AS total, count(*) AS n, round(avg(cost), 4) AS mean FROM v GROUP BY software")
C.over("o20_log_distributions", "logs", lambda d: op.distributions(d, ["level", "service"]), "SELECT 'level' AS dimension, level AS label, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'service', service, count(*) FROM v GROUP BY 2")
C.over("o21_top_errors", "logs", lambda d: op.counts_by(d, ["error_code"], where=F.col("level") == "ERROR", top=10), "SELECT error_code, count(*) AS n FROM v WHERE level = 'ERROR' GROUP BY 1 ORDER BY n DESC, error_code LIMIT 10")
C.over("o22_logs_by_hour", "logs", lambda d: op.counts_by(d, [F.hour("timestamp").alias("hour")]), "SELECT hour(timestamp)::INT AS hour, count(*) AS n FROM v GROUP BY 1")
C.over("o23_errors_by_service", "logs", lambda d: op.counts_by(d, ["service"], where=F.col("level") == "ERROR"), "SELECT service, count(*) AS n FROM v WHERE level = 'ERROR' GROUP BY 1")
C.over("o25_log_anomaly", "logs", op.logs, f"""SELECT {cnt("level = 'ERROR'")} AS errors, {cnt("level = 'WARNING'")} AS warnings, {pct(cnt("level = 'ERROR'"), 'count(*)')} AS error_rate, CASE WHEN {cnt("level = 'ERROR'")} * 100.0 / count(*) > 5 THEN 'YES' ELSE 'NO' END AS anomaly,
 (SELECT error_code FROM v WHERE level = 'ERROR' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_error, count(DISTINCT message) AS distinct_messages FROM v""")
C.over("o27_timeline", "milestones", lambda d: op.timeline(d, as_of()), f"""SELECT count(DISTINCT project_id) AS projects, count(actual_date) AS completed, {cnt('l <= 0')} AS on_time, {cnt('l > 0')} AS delayed, round(avg(l) FILTER (WHERE l > 0), 4) AS mean_delay, max(l) AS max_delay, {pct(cnt('l <= 0'), 'count(actual_date)')} AS on_time_pct,
 {cnt("status = 'at_risk'")} AS at_risk, {cnt("status = 'blocked'")} AS blocked, {cnt('s >= 0 AND s <= 30')} AS upcoming FROM (SELECT *, {days('planned_date', 'actual_date')} AS l, {days(AS_OF_SQL, 'planned_date')} AS s FROM v)""")
SLA = f"""{cnt('actual_time <= sla_target')} AS compliant, {cnt('actual_time > sla_target')} AS breached, {pct(cnt('actual_time <= sla_target'), 'count(*)')} AS rate, {cnt('actual_time > 0.9 * sla_target')} AS at_risk,
 round(avg(actual_time), 4) AS mean, round(median(actual_time), 4) AS median, round(min(actual_time), 4) AS least, round(max(actual_time), 4) AS most, round(stddev_samp(actual_time), 4) AS std"""
C.over("o30_service_levels", "tickets", op.service_levels, f"SELECT {SLA} FROM v")
C.over("o31_service_levels_by_service", "tickets", lambda d: op.service_levels(d, by=["service"]), f"SELECT service, {SLA} FROM v GROUP BY service")
SHIP = f"""count(*) AS shipments, round(sum(cost), 2) AS total_cost, round(avg(cost), 4) AS mean_cost, {cnt('on_time')} AS on_time, {cnt('NOT on_time')} AS late, {pct(cnt('on_time'), 'count(*)')} AS on_time_pct, round(avg(delivery_days), 4) AS mean_days, min(delivery_days)::BIGINT AS min_days, max(delivery_days)::BIGINT AS max_days,
 round(sum(weight), 2) AS total_weight, round(avg(cost / (weight + 1e-4)), 4) AS cost_per_weight"""
C.over("o34_shipments", "shipments", op.shipments, f"SELECT {SHIP} FROM v")
C.over("o35_vendor_performance", "shipments", lambda d: op.shipments(d, ["vendor"], top=10), f"SELECT vendor, {SHIP} FROM v GROUP BY vendor ORDER BY total_cost DESC, vendor LIMIT 10")
C.over("o36_top_routes", "shipments", lambda d: op.counts_by(d, ["origin", "destination"], top=10), "SELECT origin, destination, count(*) AS n FROM v GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10")
C.over("o37_efficient_routes", "shipments", lambda d: op.shipments(d, ["origin", "destination"], top=5, order="cost_per_weight", ascending=True), f"SELECT origin, destination, {SHIP} FROM v GROUP BY 1, 2 ORDER BY cost_per_weight, 1, 2 LIMIT 5")
C.over("h01_attendance", "attendance", op.attendance, f"""SELECT department, employee, count(*) AS records, {cnt("status = 'Present'")} AS present, {cnt("status = 'Absent'")} AS absent, {pct(cnt("status = 'Present'"), 'count(*)')} AS rate FROM v GROUP BY ROLLUP (department, employee)""")
C.over("h04_churn", "customers", op.churn, f"""SELECT lower(status) AS status, round(sum(revenue), 2) AS revenue, round(avg(revenue), 4) AS mean, count(*) AS n, (SELECT {pct(cnt("status = 'Churned'"), 'count(*)')} FROM v) AS churn_rate FROM v GROUP BY 1""")
C.over("h08_reviews", "reviews", op.reviews, """SELECT department, round(avg(review_score), 4) AS mean_score, count(review_score) AS n, (SELECT rating FROM v w WHERE w.department = v.department GROUP BY rating ORDER BY count(*) DESC, rating LIMIT 1)::BIGINT AS modal_rating FROM v GROUP BY department""")
C.over("h09_review_tiers", "reviews", op.review_tiers, f"""SELECT {cnt('review_score >= b')} AS high, {cnt('review_score >= a AND review_score < b')} AS middle, {cnt('review_score < a')} AS low, round(avg(review_score) FILTER (WHERE review_score < a), 4) AS low_mean, sum(goals_achieved)::BIGINT AS goals, {cnt('goals_achieved = m')} AS all_goals
 FROM v, (SELECT quantile_cont(review_score, 0.25) AS a, quantile_cont(review_score, 0.75) AS b, max(goals_achieved) AS m FROM v)""")
C.over("h12_recruitment", "candidates", op.recruitment, f"""SELECT {cnt("stage = 'Hired'")} AS hired, {pct(cnt("stage = 'Hired'"), 'count(*)')} AS conversion_pct, {pct(cnt("stage = 'Rejected'"), 'count(*)')} AS rejection_pct, round(avg(w), 4) AS mean_days, round(median(w), 4) AS median_days, min(w) AS min_days, max(w) AS max_days,
 round(avg(salary_offered), 4) AS mean_salary, round(median(salary_offered), 4) AS median_salary, round(min(salary_offered), 2) AS min_salary, round(max(salary_offered), 2) AS max_salary FROM (SELECT *, {days('date_applied', 'date_hired')} AS w FROM v)""")
