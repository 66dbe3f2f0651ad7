"""Tables of the star schema mapped to the columns that the operators read; the mappings run in Spark and DuckDB alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def as_of() -> Column:
    return F.lit("2001-08-02 00:00:00").cast("timestamp")


AS_OF_SQL = "TIMESTAMP '2001-08-02 00:00:00'"

VIEWS = {
    "receivables": """SELECT o_orderkey AS invoice_id, o_custkey AS customer, o_totalprice AS amount,
        CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'P' THEN o_totalprice / 2 ELSE 0.0E0 END AS amount_paid,
        CAST(o_orderkey % 120 AS INT) AS days_outstanding, o_orderdate AS date_issued, o_orderdate + INTERVAL 30 DAY AS date_due,
        CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'overdue' END AS status FROM {orders}""",
    "expenses": """SELECT o_orderkey AS expense_id, o_custkey AS employee, o_orderpriority AS category, o_totalprice AS amount, o_orderdate AS date,
        concat(CAST(o_custkey AS STRING), '-', substr(o_orderpriority, 1, 1)) AS description,
        CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status FROM {orders}""",
    "budget": """SELECT p_brand AS department, l_returnflag AS category, l_quantity * p_retailprice AS budgeted, l_extendedprice AS actual
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "cash": "SELECT ts AS date, CASE WHEN event_type = 'purchase' THEN 'inflow' ELSE 'outflow' END AS transaction_type, event_type AS category, value AS amount FROM {events}",
    "payments": """SELECT o_orderkey AS payment_id, o_totalprice AS amount, CAST(o_orderkey % 5 AS DOUBLE) AS discount_pct, o_orderkey % 3 = 0 AS discount_available,
        o_orderdate + INTERVAL 60 DAY AS due_date, o_orderpriority AS terms FROM {orders}""",
    "spend": "SELECT s_name AS vendor, l_returnflag AS category, l_linestatus AS payment_terms, l_extendedprice AS amount FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey",
    "staff": "SELECT c_name AS employee, c_mktsegment AS department, c_acctbal AS salary FROM {customer}",
    "access": """SELECT c_custkey AS user_id, CASE c_nationkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'super_admin' ELSE 'user' END AS access_level, c_mktsegment AS department,
        CAST(c_nationkey AS STRING) AS role, o_orderdate AS last_login FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey""",
    "incidents": """SELECT event_id AS incident_id, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'low' END AS severity,
        CASE event_type WHEN 'error' THEN 'open' WHEN 'click' THEN 'escalated' WHEN 'signup' THEN 'in_progress' ELSE 'closed' END AS status, event_type AS category, value AS time_to_resolve, ts AS reported_date FROM {events}""",
    "stock": """SELECT p_partkey AS sku, p_name AS product_name, CAST(p_size * 3 AS INT) AS qty_on_hand, CAST(p_size AS INT) AS qty_reserved, CAST(p_partkey % 100 AS INT) AS reorder_point, p_retailprice * p_size AS value FROM {part}""",
    "licences": """SELECT p_partkey AS license_id, p_brand AS software, CAST(p_size AS INT) AS quantity_licensed, CAST(p_partkey % 55 AS INT) AS quantity_used,
        TIMESTAMP '2001-06-01 00:00:00' + INTERVAL 1 DAY * CAST(p_partkey % 120 AS INT) AS expiry_date, p_retailprice AS cost FROM {part}""",
    "logs": "SELECT ts AS timestamp, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level, CAST(user_id AS STRING) AS service, event_type AS message, props AS error_code FROM {events}",
    "milestones": """SELECT l_orderkey AS project_id, o_orderdate + INTERVAL 60 DAY AS planned_date, l_shipdate AS actual_date,
        CASE l_returnflag WHEN 'R' THEN 'at_risk' WHEN 'A' THEN 'blocked' ELSE 'done' END AS status FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "tickets": """SELECT l_orderkey AS ticket_id, l_returnflag AS service, o_orderpriority AS priority, CAST(l_quantity AS DOUBLE) AS actual_time,
        CAST(20 + 5 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS DOUBLE) AS sla_target FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "shipments": """SELECT l_orderkey AS shipment_id, s_name AS vendor, sn.n_name AS origin, cn.n_name AS destination, l_quantity AS weight, l_extendedprice AS cost,
        CAST(l_orderkey % 15 AS INT) AS delivery_days, l_orderkey % 15 <= 9 AS on_time FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey
        JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey""",
    "mails": """SELECT role AS sender, CAST(conv_id AS STRING) AS recipient, substr(text, 1, 40) AS subject, text AS body, CAST(turn % 3 AS STRING) AS day FROM {conversations}""",
    "files": """SELECT doc_id AS pdf_id, source AS filename, text AS text_content, CAST(n_chars % 40 + 1 AS INT) AS page_count, n_chars AS file_size, CAST(n_chars % 4000 + 1 AS INT) AS width, CAST(doc_id % 2000 + 1 AS INT) AS height FROM {documents}""",
    "attendance": "SELECT CAST(user_id AS STRING) AS employee, CAST(user_id % 3 AS STRING) AS department, CASE WHEN event_type = 'error' THEN 'Absent' WHEN event_type = 'signup' THEN 'Late' ELSE 'Present' END AS status FROM {events}",
    "customers": "SELECT CASE o_orderstatus WHEN 'F' THEN 'Churned' WHEN 'O' THEN 'active' ELSE 'paused' END AS status, o_totalprice AS revenue FROM {orders}",
    "reviews": "SELECT c_mktsegment AS department, CAST(c_nationkey % 5 + 1 AS INT) AS rating, CAST(c_nationkey AS INT) AS goals_achieved, c_acctbal AS review_score FROM {customer}",
    "candidates": "SELECT CASE o_orderstatus WHEN 'F' THEN 'Hired' WHEN 'O' THEN 'Rejected' ELSE 'Interview' END AS stage, o_orderdate AS date_applied, o_orderdate + INTERVAL 1 DAY * CAST(o_orderkey % 40 AS INT) AS date_hired, o_totalprice AS salary_offered FROM {orders}",
    "campaigns": """SELECT l_orderkey AS campaign_id, l_returnflag AS channel, sum(l_tax * l_extendedprice) AS spent, CAST(sum(l_quantity) * 100 AS DOUBLE) AS impressions, CAST(sum(l_quantity) AS DOUBLE) AS clicks,
        CAST(count(CASE WHEN l_discount > 0.05E0 THEN 1 END) AS DOUBLE) AS conversions, sum(l_extendedprice * (1 - l_discount)) * 0.05E0 AS revenue, min(l_shipdate) AS date FROM {lineitem} GROUP BY l_orderkey, l_returnflag""",
    "deals": """SELECT o_orderkey AS deal_id, o_totalprice AS amount, CASE o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'O' THEN 'Proposal' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Closed Lost' ELSE 'Discovery call' END END AS stage,
        CAST(o_orderkey % 101 AS DOUBLE) AS probability, o_orderdate AS created_date, o_orderdate + INTERVAL 1 DAY * CAST(o_orderkey % 200 AS INT) AS close_date, CAST(o_custkey % 17 AS STRING) AS rep FROM {orders}""",
    "leads": """SELECT o_orderkey AS lead_id, c_mktsegment AS source, c_name AS company, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'Closed-Won' WHEN 1 THEN 'MQL' WHEN 2 THEN 'lost' WHEN 3 THEN 'Open_Opportunity' WHEN 4 THEN 'new lead' ELSE 'Dead' END AS status,
        o_totalprice AS value, CAST(o_orderkey % 130 AS DOUBLE) AS age_days, o_orderdate AS date FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def oracle(name: str, select: str) -> str:
    """A query over a view, named v, for DuckDB."""
    text = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]).replace("AS STRING", "AS VARCHAR")
    return f"WITH v AS ({text}) {select}"


class Catalog:
    """Queries with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def over(self, name: str, view_name: str, build: Callable[[DataFrame], DataFrame], select: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: build(view(spark, sf_dir, view_name))
        if select:
            self.sql[name] = oracle(view_name, select)

    def on(self, name: str, table: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: build(read(spark, sf_dir, table))
        if sql:
            self.sql[name] = sql

    def free(self, name: str, build: Query, sql: str | None = None) -> None:
        self.queries[name] = build
        if sql:
            self.sql[name] = sql
