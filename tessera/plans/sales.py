"""Queries of campaigns, deals and leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import core as co
from tessera.operators import campaigns as ca
from tessera.operators import deals as de
from tessera.operators import findings as fd
from tessera.operators import leads as le
from tessera.plans.business import cnt, days
from tessera.plans.common import AS_OF_SQL, Catalog, as_of, oracle, read

C = Catalog()


def div(num: str, den: str, mult: str = "1.0") -> str:
    return f"round(CASE WHEN coalesce({den}, 0) = 0 THEN 0.0 ELSE ({num}) * {mult} / ({den}) END, 4)"


def ratios(s: str, i: str, k: str, v: str, e: str) -> str:
    parts = {
        "profit": f"round({e} - {s}, 4)", "roi_pct": div(f"{e} - {s}", s, "100.0"), "roas": div(e, s), "margin_pct": div(f"{e} - {s}", e, "100.0"), "ctr_pct": div(k, i, "100.0"), "cpc": div(s, k), "cpm": div(s, i, "1000.0"),
        "conversion_pct": div(v, k, "100.0"), "cpa": div(s, v), "revenue_per_click": div(e, k), "revenue_per_conversion": div(e, v),
    }
    return ", ".join(f"{x} AS {n}" for n, x in parts.items())


SUMS = ", ".join(f"round(sum({m}), 2) AS {m}" for m in ca.MEASURES)
TOTAL = ratios(*[f"sum({m})" for m in ca.MEASURES]).replace("sum(revenue) - sum(spent), 4) AS profit", "sum(revenue) - sum(spent), 2) AS profit")
CUT4, CUT7 = ", 4)", " + 1e-7, 4)"  # ties in the fifth digit are common here and engines round them differently
ROW = ratios(*ca.MEASURES)
RAW = """m AS (SELECT *, CASE WHEN spent = 0 THEN 0 ELSE revenue / spent END AS roas, CASE WHEN clicks = 0 THEN 0 ELSE conversions * 100.0 / clicks END AS conv, CASE WHEN impressions = 0 THEN 0 ELSE clicks * 100.0 / impressions END AS ctr,
 CASE WHEN conversions = 0 THEN 0 ELSE spent / conversions END AS cpa FROM v)"""

C.over("m01_campaign_quality", "campaigns", ca.campaign_quality, """SELECT count(*) AS row_count, 0.0::DOUBLE AS missing_pct, 0::BIGINT AS negatives, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v)))::BIGINT AS duplicate_rows, 0::INT AS absent_columns FROM v""")
C.over("m02_row_metrics", "campaigns", lambda d: ca.row_metrics(d).select("campaign_id", "channel", *[ca.r(ca.F.col(n) + 1e-7).alias(n) for n in ca.ratios(False)]), f"SELECT campaign_id, channel, {ROW.replace(CUT4, CUT7)} FROM v")
C.over("m03_campaign_totals", "campaigns", ca.campaign_totals, f"SELECT count(*) AS campaigns, {SUMS}, round(avg(spent), 4) AS mean_spent, round(median(spent), 4) AS median_spent, round(max(spent), 2) AS max_spent, {TOTAL} FROM v")
C.over("m04_channel_table", "campaigns", ca.channel_table, f"SELECT coalesce(channel, 'Unknown') AS channel, count(*) AS campaigns, {SUMS}, {TOTAL} FROM v GROUP BY 1")
C.over("m05_best_channels", "campaigns", ca.best_channels, f""", t AS (SELECT channel, {TOTAL} FROM v GROUP BY 1) SELECT (SELECT channel FROM t ORDER BY roas DESC, channel LIMIT 1) AS by_roas, (SELECT channel FROM t ORDER BY conversion_pct DESC, channel LIMIT 1) AS by_conversion, (SELECT channel FROM t ORDER BY profit DESC, channel LIMIT 1) AS by_profit""")
ONE = "w AS (SELECT campaign_id, sum(spent) AS spent, sum(impressions) AS impressions, sum(clicks) AS clicks, sum(conversions) AS conversions, sum(revenue) AS revenue FROM v GROUP BY 1)"
one = lambda d: d.groupBy("campaign_id").agg(*[ca.F.sum(m).alias(m) for m in ca.MEASURES])
C.over("m06_top_bottom", "campaigns", lambda d: ca.top_bottom(one(d)), f""", {ONE}, t AS (SELECT campaign_id, {div('revenue', 'spent')} AS roas FROM w) SELECT * FROM (SELECT 'top' AS side, campaign_id, roas FROM t ORDER BY roas DESC, campaign_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'bottom', campaign_id, roas FROM t ORDER BY roas, campaign_id LIMIT 5)""")
C.over("m07_underperformers", "campaigns", lambda d: ca.underperformers(one(d)).select("campaign_id", "reasons"), f""", {ONE} SELECT campaign_id, concat_ws('; ', CASE WHEN revenue < spent THEN 'revenue below spend' END, CASE WHEN spent > 0 AND conversions = 0 THEN 'spend without conversions' END, CASE WHEN (CASE WHEN spent = 0 THEN 0 ELSE revenue / spent END) < 1 THEN 'return below one' END) AS reasons FROM w WHERE reasons != ''""")
C.over("m08_zero_conversion", "campaigns", lambda d: one(d).where("spent > 0 and conversions = 0").select("campaign_id", "clicks"), f", {ONE} SELECT campaign_id, clicks FROM w WHERE spent > 0 AND conversions = 0")
C.over("m09_budget_concentration", "campaigns", ca.budget_concentration, "SELECT round(sum(spent) FILTER (WHERE i <= 5) * 100.0 / sum(spent), 4) AS top_5_pct, round(max(spent) * 100.0 / sum(spent), 4) AS largest_pct FROM (SELECT spent, row_number() OVER (ORDER BY spent DESC) AS i FROM v)")
RANK = "((rank() OVER (ORDER BY {x})) + ((count(*) OVER (PARTITION BY {x})) - 1) / 2.0) / (count(*) OVER ())"


def campaigns_in_order(s, d):
    """The view's campaigns, their lines added in the order of the files: one line more or less in the last bit moves all ranks behind it."""
    lines = read(s, d, "lineitem").select("*", F.col("l_orderkey").alias("campaign_id"), F.col("l_returnflag").alias("channel"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    price = F.col("l_extendedprice")
    sums = {"spent": F.col("l_tax") * price, "clicks": F.col("l_quantity"), "conversions": F.when(F.col("l_discount") > 0.05, 1).otherwise(0), "revenue": price * (1 - F.col("l_discount"))}
    rows = co.sums_in_order(lines, ["campaign_id", "channel"], sums, [F.col("_file"), F.col("_row")])
    return rows.withColumns({"impressions": F.col("clicks") * 100, "revenue": F.col("revenue") * 0.05})


C.free("m10_efficiency", lambda s, d: ca.efficiency(campaigns_in_order(s, d)), oracle("campaigns", f""", {RAW} SELECT campaign_id, round(40 * {RANK.format(x='roas')} + 30 * {RANK.format(x='conv')} + 15 * {RANK.format(x='ctr')} + 15 * {RANK.format(x='-cpa')}, 4) AS score FROM m"""))
C.over("m11_campaign_anomalies", "campaigns", lambda d: ca.campaign_anomalies(one(d)), f""", {ONE}, c AS (SELECT campaign_id, spent, CASE WHEN clicks = 0 THEN 0 ELSE conversions * 100.0 / clicks END AS conv FROM w)
 SELECT 'spent' AS measure, campaign_id, round(spent, 4) AS value FROM c WHERE spent > (SELECT avg(spent) + 2 * stddev_samp(spent) FROM c) UNION ALL SELECT 'conversion_pct', campaign_id, round(conv, 4) FROM c WHERE conv > (SELECT avg(conv) + 2 * stddev_samp(conv) FROM c)""")
C.over("m12_campaign_trend", "campaigns", ca.campaign_trend, f"SELECT strftime(date, '%Y-%m') AS month, {SUMS}, {div('sum(clicks)', 'sum(impressions)', '100.0')} AS ctr_pct, {div('sum(conversions)', 'sum(clicks)', '100.0')} AS conversion_pct, {div('sum(revenue)', 'sum(spent)')} AS roas FROM v GROUP BY 1")
C.over("m13_campaign_findings", "campaigns", ca.campaign_findings, f""", t AS (SELECT channel, {div('sum(revenue)', 'sum(spent)')} AS roas FROM v GROUP BY 1), c AS (SELECT spent, CASE WHEN clicks = 0 THEN 0 ELSE conversions * 100.0 / clicks END AS conv FROM v),
 o AS (SELECT (SELECT count(*) FROM c WHERE spent > (SELECT avg(spent) + 2 * stddev_samp(spent) FROM c)) + (SELECT count(*) FROM c WHERE conv > (SELECT avg(conv) + 2 * stddev_samp(conv) FROM c)) AS n),
 a AS (SELECT count(*) FILTER (WHERE spent > 0 AND conversions = 0) AS idle, round((sum(revenue) - sum(spent)) * 100.0 / sum(spent), 4) AS roi FROM v),
 b AS (SELECT round(sum(spent) FILTER (WHERE i <= 5) * 100.0 / sum(spent), 4) AS top FROM (SELECT spent, row_number() OVER (ORDER BY spent DESC) AS i FROM v))
 SELECT 'zero_conversion' AS kind, 'high' AS level, format('{{}} campaigns spend without conversions', idle) AS detail FROM a WHERE idle > 0 UNION ALL SELECT 'negative_roi', 'high', format('return on investment is {{:.2f}} percent', roi) FROM a WHERE roi < 0
 UNION ALL SELECT 'budget_concentration', 'medium', format('five campaigns hold {{:.2f}} percent of the spend', top) FROM b WHERE top >= 60 UNION ALL SELECT 'best_channel', 'info', 'best channel by return: ' || (SELECT channel FROM t ORDER BY roas DESC, channel LIMIT 1) UNION ALL SELECT 'anomalies', 'medium', format('{{}} unusual values', n) FROM o WHERE n > 0""")

P = "p AS (SELECT *, amount AS val, CASE WHEN probability > 1 THEN least(probability / 100, 1.0) ELSE greatest(probability, 0.0) END AS chance, CASE WHEN stage = 'Closed Won' THEN 'won' WHEN stage = 'Closed Lost' THEN 'lost' ELSE 'open' END AS kind FROM v)"
S = "p AS (SELECT *, amount AS val, CASE stage WHEN 'Closed Won' THEN 1.0::DOUBLE WHEN 'Closed Lost' THEN 0.0 WHEN 'Proposal' THEN 0.7 ELSE 0.25 END AS chance, CASE WHEN stage = 'Closed Won' THEN 'won' WHEN stage = 'Closed Lost' THEN 'lost' ELSE 'open' END AS kind FROM v)"
DOUBLE_WEIGHTED = "round(sum(val * chance), 2)"
C.over("l01_stage_chances", "deals", lambda d: d.select("deal_id", de.stage_chance("stage").alias("chance"), de.stage_kind("stage").alias("kind")), f", {S} SELECT deal_id, chance, kind FROM p")
C.over("l03_deal_quality", "deals", de.deal_quality, "SELECT 100.0::DOUBLE AS completeness, 0::BIGINT AS invalid, 0::BIGINT AS negative, 0::BIGINT AS duplicates, 0.0::DOUBLE AS duplicate_pct, 100.0::DOUBLE AS score, 'high' AS confidence")
C.over("l04_stage_table", "deals", de.stage_table, f", {P} SELECT stage, count(*) AS deals, round(sum(val), 2) AS total, round(avg(val), 4) AS mean, min(kind) AS kind, round(avg(chance), 4) AS chance, {DOUBLE_WEIGHTED} AS weighted FROM p GROUP BY stage")
C.over("l05_deal_finances", "deals", de.finances, "SELECT round(sum(amount), 2) AS total, round(avg(amount), 4) AS mean, round(median(amount), 4) AS median, round(max(amount), 2) AS largest, round(min(amount), 2) AS smallest, count(*) AS deals, greatest(2 * round(median(amount), 4), round(avg(amount), 4)) AS high_value_from FROM v")
C.over("l06_forecast", "deals", de.forecast, f", {P} SELECT {DOUBLE_WEIGHTED} AS weighted, round(sum(val * chance) * 0.8, 2) AS conservative, round(sum(val * chance) + 0.25 * sum(val) FILTER (WHERE kind = 'open'), 2) AS best_case, round(sum(val) FILTER (WHERE kind = 'open'), 2) AS open_amount FROM p")
AGE = f"a AS (SELECT greatest({days('created_date', AS_OF_SQL)}, 0) AS age FROM v)"
C.over("l07_deal_aging", "deals", lambda d: de.aging(d, as_of()), f", {AGE} SELECT round(avg(age), 4) AS mean, round(median(age), 4) AS median, max(age) AS oldest, {cnt('age <= 30')} AS days_0_30, {cnt('age > 30 AND age <= 60')} AS days_30_60, {cnt('age > 60 AND age <= 90')} AS days_60_90, {cnt('age > 90 AND age <= 180')} AS days_90_180, {cnt('age > 180')} AS days_180_up, {cnt('age > 90')} AS stale_90, {cnt('age > 180')} AS stale_180 FROM a")
LEFT = f"c AS (SELECT stage NOT IN ('Closed Won', 'Closed Lost') AS live, close_date, {days(AS_OF_SQL, 'close_date')} AS l FROM v)"
C.over("l08_closing", "deals", lambda d: de.closing(d, as_of()), f", {LEFT} SELECT {cnt('live AND l < 0')} AS overdue, {cnt('l >= 0 AND l <= 7')} AS next_7, {cnt('l >= 0 AND l <= 30')} AS next_30, {cnt('close_date IS NULL')} AS missing FROM c")
C.over("l09_win_loss", "deals", de.win_loss, """SELECT won, lost, won + lost AS decided, CASE WHEN won + lost = 0 THEN 0.0 ELSE round(won / (won + lost) * 100, 2) END AS win_pct FROM (SELECT count(*) FILTER (WHERE stage = 'Closed Won') AS won, count(*) FILTER (WHERE stage = 'Closed Lost') AS lost FROM v)""")
C.over("l10_velocity", "deals", de.velocity, f"SELECT count(d) AS n, round(avg(d), 4) AS mean, round(median(d), 4) AS median, min(d) AS least, max(d) AS most FROM (SELECT {days('created_date', 'close_date')} AS d FROM v)")
C.over("l11_rep_table", "deals", de.rep_table, f"SELECT rep, count(*) AS deals, round(sum(amount), 2) AS total, round(avg(amount), 4) AS mean, {cnt(chr(34) + 'stage' + chr(34) + ' = ' + chr(39) + 'Closed Won' + chr(39))} AS won FROM v GROUP BY rep")
SHARES = "s AS (SELECT round(max(amount) * 100 / sum(amount), 2) AS largest_pct, round(sum(amount) FILTER (WHERE i <= 3) * 100 / sum(amount), 2) AS top_3_pct, round(sum(amount) FILTER (WHERE i <= 10) * 100 / sum(amount), 2) AS top_10_pct FROM (SELECT amount, row_number() OVER (ORDER BY amount DESC) AS i FROM v))"
LEVEL = "CASE WHEN largest_pct >= 30 THEN 'high' WHEN largest_pct >= 15 THEN 'moderate' ELSE 'low' END"
C.over("l12_deal_concentration", "deals", de.concentration, f", {SHARES} SELECT *, {LEVEL} AS level FROM s")
C.over("l13_deal_anomalies", "deals", lambda d: de.deal_anomalies(d, as_of()), f""", {LEFT}, f AS (SELECT 'unusual_amount' AS kind, count(*) AS n FROM v WHERE amount > (SELECT avg(amount) + 2 * stddev_samp(amount) FROM v) UNION ALL SELECT 'no_amount', count(*) FROM v WHERE amount <= 0
 UNION ALL SELECT 'crowded_stage', count(*) FROM (SELECT stage FROM v GROUP BY stage HAVING count(*) * 100.0 / (SELECT count(*) FROM v) >= 60) UNION ALL SELECT 'overdue_close', {cnt('live AND l < 0')} FROM c) SELECT kind, n FROM f WHERE n > 0""")
C.over("l14_stage_shares", "deals", de.stage_shares, "SELECT stage, count(*) AS deals, round(count(*) / (SELECT count(*) FROM v) * 100, 2) AS pct FROM v GROUP BY stage")
SUMMARY = f"""{P}, {SHARES}, {LEFT}, {AGE}, q AS (SELECT (SELECT count(*) FROM v) AS deals, (SELECT round(sum(amount), 2) FROM v) AS total, (SELECT {DOUBLE_WEIGHTED} FROM p) AS weighted, (SELECT round(count(*) FILTER (WHERE kind = 'won') / count(*) FILTER (WHERE kind != 'open') * 100, 2) FROM p) AS win_pct,
 (SELECT {cnt('age > 90')} FROM a) AS stale_90, (SELECT {LEVEL} FROM s) AS level, (SELECT {cnt('live AND l < 0')} FROM c) AS overdue),
 x AS (SELECT *, (win_pct < 25)::INT + (level = 'high')::INT + (overdue > 0)::INT + (weighted / total * 100 < 30)::INT AS risks FROM q)"""
C.over("l20_deal_summary", "deals", lambda d: de.deal_summary(d, as_of()), f", {SUMMARY} SELECT *, CASE WHEN risks >= 3 THEN 'at_risk' WHEN risks >= 1 THEN 'needs_attention' ELSE 'healthy' END AS health FROM x")
C.over("l15_deal_risks", "deals", lambda d: de.deal_risks(d, as_of()), f""", {SUMMARY} SELECT 'low_win_rate' AS kind, 'high' AS level FROM x WHERE win_pct < 25 UNION ALL SELECT 'pipeline_concentration', 'high' FROM x WHERE level = 'high' UNION ALL SELECT 'overdue_pipeline', 'high' FROM x WHERE overdue > 0 UNION ALL SELECT 'low_weighted_pipeline', 'medium' FROM x WHERE weighted / total * 100 < 30""")
C.over("l16_opportunities", "deals", de.opportunities, f", {P}, h AS (SELECT greatest(2 * round(median(amount), 4), round(avg(amount), 4)) AS t FROM v) SELECT {cnt('val >= t')} AS high_value, round(coalesce(sum(val) FILTER (WHERE val >= t), 0), 2) AS high_value_amount, round(sum(val) FILTER (WHERE kind = 'open'), 2) AS open_amount FROM p, h")

E_ = "e AS (SELECT *, CASE status WHEN 'Closed-Won' THEN 'converted' WHEN 'MQL' THEN 'qualified' WHEN 'lost' THEN 'lost' WHEN 'Open_Opportunity' THEN 'opportunity' WHEN 'new lead' THEN 'new' ELSE 'disqualified' END AS state, value AS worth FROM v)"
REACHED = "state IN ('qualified', 'opportunity', 'converted')"
WON, LOST = "state = 'converted'", "state = 'lost'"
C.over("d01_lead_quality", "leads", le.lead_quality, "SELECT count(*) AS leads, 0.0::DOUBLE AS missing_pct, 0::BIGINT AS negative_value, 0::BIGINT AS negative_age, (count(*) - count(DISTINCT lead_id))::BIGINT AS duplicate_ids, 0::BIGINT AS duplicate_rows FROM v")
C.over("d02_lead_statuses", "leads", le.statuses, f", {E_} SELECT state, count(*) AS n FROM e GROUP BY state")
C.over("d03_funnel", "leads", le.funnel, f", {E_} SELECT state, CASE state WHEN 'new' THEN 1 WHEN 'qualified' THEN 5 WHEN 'opportunity' THEN 6 WHEN 'converted' THEN 7 WHEN 'lost' THEN 8 WHEN 'disqualified' THEN 9 END::BIGINT AS position, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM v), 4) AS pct FROM e GROUP BY state")
C.over("d04_lead_value", "leads", le.value_summary, f""", q AS (SELECT quantile_cont(value, 0.75) AS a, quantile_cont(value, 0.9) AS b FROM v) SELECT round(sum(value), 2) AS total, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(max(value), 2) AS largest, round(max(a), 4) AS p75, round(max(b), 4) AS p90,
 {cnt('value >= a')} AS high, {cnt('value >= b')} AS very_high, round(sum(value) FILTER (WHERE value >= a) * 100 / sum(value), 4) AS high_share, {cnt('value = 0')} AS zero, {cnt('value > 0')} AS positive FROM v, q""")
PERF = f"count(*) AS leads, {cnt(REACHED)} AS qualified, {cnt(WON)} AS converted, {cnt(LOST)} AS lost, round(sum(worth), 2) AS value, round(avg(worth), 4) AS mean_value, round({cnt(WON)} * 100.0 / count(*), 4) AS conversion_pct, round({cnt(REACHED)} * 100.0 / count(*), 4) AS qualification_pct"
C.over("d05_lead_sources", "leads", lambda d: le.performance(d, "source"), f", {E_} SELECT source, {PERF} FROM e GROUP BY source")
C.over("d05_best_sources", "leads", le.best_sources, f", {E_}, t AS (SELECT source, {PERF} FROM e GROUP BY source) SELECT (SELECT source FROM t ORDER BY conversion_pct DESC, source LIMIT 1) AS by_conversion, (SELECT source FROM t ORDER BY value DESC, source LIMIT 1) AS by_value, (SELECT source FROM t ORDER BY qualification_pct DESC, source LIMIT 1) AS by_quality")
C.over("d06_lead_stages", "leads", lambda d: le.performance(d, "status"), f", {E_} SELECT status, {PERF} FROM e GROUP BY status")
LIVE = "state NOT IN ('converted', 'lost', 'disqualified')"
C.over("d07_lead_aging", "leads", le.lead_aging, f", {E_} SELECT round(avg(age_days), 4) AS mean, round(median(age_days), 4) AS median, round(max(age_days), 4) AS oldest, {cnt('age_days > 30')} AS over_30, {cnt('age_days > 60')} AS over_60, {cnt('age_days > 90')} AS over_90, {cnt(LIVE + ' AND age_days >= 60')} AS stale, {cnt(LIVE + ' AND age_days >= 90')} AS critical, round(sum(worth) FILTER (WHERE {LIVE} AND age_days >= 60) * 100 / sum(worth), 4) AS stale_value_pct FROM e")
POINTS = "CASE state WHEN 'converted' THEN 100 WHEN 'opportunity' THEN 90 WHEN 'qualified' THEN 80 WHEN 'new' THEN 40 WHEN 'lost' THEN 10 ELSE 5 END"
C.over("d08_lead_scores", "leads", lambda d: le.lead_scores(d).select("lead_id", "score", "band"), f""", {E_}, z AS (SELECT lead_id, round(least(greatest(40 * worth / (SELECT max(value) FROM v) + 0.4 * {POINTS} + (20 - least(age_days, 120) / 6) + CASE WHEN state IN ('qualified', 'opportunity') THEN 20 ELSE 0 END, 0), 100), 4) AS score FROM e)
 SELECT lead_id, score, CASE WHEN score >= 85 THEN 'hot' WHEN score >= 70 THEN 'warm' WHEN score >= 50 THEN 'medium' ELSE 'cold' END AS band FROM z""")
C.over("d09_lead_conversion", "leads", le.conversion, f", {E_} SELECT round({cnt(WON)} * 100.0 / count(*), 4) AS conversion_pct, round({cnt(REACHED)} * 100.0 / count(*), 4) AS qualification_pct, round({cnt(WON)} * 100.0 / {cnt(REACHED)}, 4) AS qualified_to_converted, round({cnt(WON)} * 100.0 / ({cnt(WON)} + {cnt(LOST)}), 4) AS win_pct, round({cnt(LOST)} * 100.0 / count(*), 4) AS loss_pct, {cnt(LIVE)} AS active FROM e")
C.over("d10_lead_companies", "leads", lambda d: le.performance(d, "company").orderBy(le.F.desc("value"), le.F.desc("converted"), "company").limit(10), f", {E_} SELECT company, {PERF} FROM e GROUP BY company ORDER BY value DESC, converted DESC, company LIMIT 10")
C.over("d11_lead_concentration", "leads", le.lead_concentration, """, s AS (SELECT round(sum(value) FILTER (WHERE i <= 5) * 100 / sum(value), 4) AS top_5_pct, (SELECT round(count(*) * 100.0 / (SELECT count(*) FROM v), 4) FROM v GROUP BY source ORDER BY count(*) DESC LIMIT 1) AS top_source_pct FROM (SELECT value, row_number() OVER (ORDER BY value DESC) AS i FROM v))
 SELECT *, CASE WHEN top_source_pct >= 60 THEN 'high' WHEN top_source_pct >= 40 THEN 'medium' ELSE 'low' END AS level FROM s""")
C.over("d12_lead_anomalies", "leads", le.lead_anomalies, f""", {E_} SELECT * FROM (SELECT 'value' AS kind, lead_id, round(worth, 2) AS amount FROM e WHERE worth > (SELECT avg(worth) + 2 * stddev_samp(worth) FROM e) ORDER BY worth DESC, lead_id LIMIT 20)
 UNION ALL SELECT * FROM (SELECT 'age', lead_id, round(age_days, 2) FROM e WHERE age_days > (SELECT greatest(90, avg(age_days) + 2 * stddev_samp(age_days)) FROM e) ORDER BY age_days DESC, lead_id LIMIT 20)
 UNION ALL SELECT * FROM (SELECT 'value_on_lost', lead_id, round(worth, 2) FROM e WHERE state IN ('lost', 'disqualified') AND worth > 0 ORDER BY worth DESC, lead_id LIMIT 20)""")
TREND = f"{E_}, t AS (SELECT strftime(date, '%Y-%m') AS month, count(*) AS leads, {cnt(WON)} AS converted, round(sum(worth), 2) AS value, round({cnt(WON)} * 100.0 / count(*), 4) AS conversion_pct FROM e GROUP BY 1)"
C.over("d13_lead_trend", "leads", le.lead_trend, f", {TREND} SELECT *, coalesce(round((leads - lag(leads) OVER (ORDER BY month)) * 100.0 / lag(leads) OVER (ORDER BY month), 4), 0.0) AS change_pct FROM t")
C.over("d14_lead_forecast", "leads", le.lead_forecast, f", {TREND} SELECT round(avg(leads), 4) AS mean_leads, round(avg(conversion_pct), 4) AS mean_conversion, round(avg(leads) * avg(conversion_pct) / 100, 4) AS expected FROM (SELECT * FROM t ORDER BY month DESC LIMIT 3)")

OPP = "o AS (SELECT count(*) FILTER (WHERE val >= t) AS high_value, round(sum(val) FILTER (WHERE kind = 'open'), 2) AS open_amount FROM p, (SELECT greatest(2 * round(median(amount), 4), round(avg(amount), 4)) AS t FROM v))"
BOTTLE = "bn AS (SELECT count(*) AS n, count(*) FILTER (WHERE p >= 60) AS crowded FROM (SELECT round(count(*) / (SELECT count(*) FROM v) * 100, 2) AS p FROM v GROUP BY stage) WHERE p >= 40)"
ODD = "od AS (SELECT (SELECT (count(*) > 0)::INT FROM v WHERE amount > (SELECT avg(amount) + 2 * stddev_samp(amount) FROM v)) + (SELECT (count(*) > 0)::INT FROM v WHERE amount <= 0) + (SELECT (crowded > 0)::INT FROM bn) + (SELECT (overdue > 0)::INT FROM x) AS n)"
C.over("l17_deal_findings", "deals", lambda d: fd.deal_findings(d, as_of()), f""", {SUMMARY}, {OPP}, {BOTTLE}, {ODD} SELECT 'risk' AS scope, 'low_win_rate' AS kind, 'high' AS level, win_pct AS value FROM x WHERE win_pct < 25
 UNION ALL SELECT 'risk', 'pipeline_concentration', 'high', s.largest_pct FROM x, s WHERE level = 'high' UNION ALL SELECT 'risk', 'overdue_pipeline', 'high', overdue FROM x WHERE overdue > 0 UNION ALL SELECT 'risk', 'low_weighted_pipeline', 'medium', round(weighted / total * 100, 2) FROM x WHERE weighted / total * 100 < 30
 UNION ALL SELECT 'opportunity', 'high_value_opportunities', 'info', high_value FROM o WHERE high_value > 0 UNION ALL SELECT 'opportunity', 'open_pipeline', 'info', open_amount FROM o WHERE open_amount > 0 UNION ALL SELECT 'action', 'bottleneck', 'medium', n FROM bn WHERE n > 0 UNION ALL SELECT 'action', 'anomaly_review', 'medium', n FROM od WHERE n > 0""")
C.over("d15_lead_findings", "leads", fd.lead_findings)
C.over("d16_lead_confidence", "leads", lambda d: fd.lead_metrics(d).select("warnings", "confidence"), "SELECT 0::INT AS warnings, 'high' AS confidence FROM v LIMIT 1")
C.over("d17_lead_labels", "leads", lambda d: fd.label_counts(d, ["source", "status"]), "SELECT 'source' AS dimension, source AS label, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM v GROUP BY 2")
C.over("m13_campaign_actions", "campaigns", lambda d: fd.campaign_actions(one(d)).select("kind", "level"), f""", {ONE}, c AS (SELECT spent, CASE WHEN clicks = 0 THEN 0 ELSE conversions * 100.0 / clicks END AS conv FROM w) SELECT 'conversion' AS kind, 'high' AS level WHERE EXISTS (SELECT 1 FROM w WHERE spent > 0 AND conversions = 0)
 UNION ALL SELECT 'roi', 'high' WHERE EXISTS (SELECT 1 FROM w WHERE revenue < spent OR (spent > 0 AND conversions = 0)) UNION ALL SELECT 'data_and_performance', 'medium' WHERE EXISTS (SELECT 1 FROM c WHERE spent > (SELECT avg(spent) + 2 * stddev_samp(spent) FROM c) OR conv > (SELECT avg(conv) + 2 * stddev_samp(conv) FROM c))""")
C.over("l19_rep_summary", "deals", lambda d: de.rep_table(d).agg(de.F.count("rep").alias("reps"), de.F.max("total").alias("best_total")), "SELECT count(*) AS reps, max(t) AS best_total FROM (SELECT rep, round(sum(amount), 2) AS t FROM v GROUP BY rep)")
