"""Queries: packed cells, visit ranks, changes, baselines, trajectories, trends."""

from pyspark.sql import functions as F

from ..functions.coding import delay_bin
from ..operators import joins, longitudinal, reshape
from ..operators.skew import attach
from ..plans import battery
from .registry import query

VISITS_SQL = """
e AS (SELECT user_id, event_type, event_id, CAST(ts AS DATE) AS d, value FROM events),
reg AS (SELECT user_id, min(d) AS r FROM e GROUP BY ALL),
v AS (SELECT e.*, date_diff('day', r, d) AS days FROM e JOIN reg USING (user_id)),
lon AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY days, d) AS rank,
  date_diff('day', lag(d) OVER w, d) AS gap, value - lag(value) OVER w AS delta
  FROM v WINDOW w AS (PARTITION BY user_id, event_type ORDER BY days, d, event_id))"""


def visits(t):
    e = t.events.select("user_id", "event_type", "event_id", F.to_date("ts").alias("d"), "value")
    first = e.groupBy("user_id").agg(F.min("d").alias("r"), F.count(F.lit(1)).alias("n"))
    return attach(e, first, ["user_id"], how="inner", keep_size=False)


def visit_rows(t):
    return longitudinal.visit_table(visits(t), "user_id", "d", "value", "event_type", "r", ["event_id"])


@query("W1 W2 W3 C19", f"""WITH {VISITS_SQL} SELECT event_id, user_id, event_type, days AS diff_btw_re_and_me, rank, gap::DOUBLE AS diff_btw_me,
 round(delta, 6) AS delta, round(CASE WHEN gap <> 0 THEN delta / (gap / 365.0) END, 5) AS delta_per_year FROM lon""", delta_per_year=5)
def visit_rank_delta(t):
    return visit_rows(t).select("event_id", "user_id", "event_type", F.col("diff_btw_re_and_me").cast("bigint").alias("diff_btw_re_and_me"), "rank",
                                F.col("diff_btw_me").cast("double").alias("diff_btw_me"), "delta", "delta_per_year")


@query("W5", f"""WITH {VISITS_SQL} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS subjects, round(avg(value), 6) AS mean_value
 FROM lon WHERE rank = 1 OR rank IS NULL GROUP BY ALL""")
def baseline_only(t):
    return longitudinal.baseline(visit_rows(t)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("subjects"), F.avg("value").alias("mean_value"))


@query("W4", """SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS num FROM events""")
def record_numbers(t):
    return longitudinal.number_records(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "event_id", "user_id", "event_type", "num")


BLOCK = 64  # events per packed cell at most, as ids are unique


def block():
    return F.floor(F.col("event_id") / BLOCK).alias("block")


def packed_days(t):
    """Events of one user, day and id block packed into one cell, as the registries hold visits."""
    rows = t.events.select("user_id", "event_type", F.to_date("ts").alias("d"), block(), "event_id", "value")
    cells = rows.groupBy("user_id", "d", "block").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("x"))
    part = lambda f: F.array_join(F.transform("x", lambda s: s[f].cast("string")), "\n")
    return cells.select("user_id", "d", part("event_id").alias("ids"), part("event_type").alias("types"),
                        part("value").alias("values"))


@query("C15 C9", """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, CAST(event_id AS VARCHAR) AS ids, event_type AS types, value AS value_number,
 count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE), event_id // 64) AS packed FROM events""")
def unpack_rows(t):
    from ..functions.text import pieces
    packed = packed_days(t).withColumn("packed", pieces("ids").cast("bigint"))
    rows = reshape.unpack(packed, ["ids", "types", "values"])
    return rows.select("user_id", F.col("d").cast("string").alias("d"), "ids", "types", F.col("values").try_cast("double").alias("value_number"), "packed")


@query("W6 C15 C16 C25 C26 U1", """WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d, value FROM events WHERE event_type IN ('click', 'error') AND NOT (event_type = 'click' AND value < 10)),
reg AS (SELECT user_id, CAST(min(ts) AS DATE) AS r FROM events GROUP BY ALL),
v AS (SELECT e.*, date_diff('day', r, d) AS days FROM e JOIN reg USING (user_id)),
lon AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY days, d) AS rank, date_diff('day', lag(d) OVER w, d) AS gap, value - lag(value) OVER w AS delta
 FROM v WINDOW w AS (PARTITION BY user_id, event_type ORDER BY days, d, value))
SELECT user_id, event_type AS measurement, CAST(d AS VARCHAR) AS measurement_date, value AS measurement_value, rank, days AS diff_btw_re_and_me, gap::DOUBLE AS diff_btw_me,
 round(delta, 6) AS delta, round(CASE WHEN gap <> 0 THEN delta / (gap / 365.0) END, 5) AS delta_per_year FROM lon""", delta_per_year=5)
def packed_longitudinal(t):
    """Packed master rows per user and id block, all events: in the column of an event type the others, and low clicks, are 'ND'."""
    e = t.events
    shown = F.when((F.col("event_type") == "click") & (F.col("value") < 10), "ND").otherwise(F.col("value").cast("string"))
    cells = e.groupBy("user_id", block()).agg(F.sort_array(F.collect_list(F.struct(
        F.col("event_id"), F.date_format("ts", "yyyy/MM/dd").alias("d"), F.col("event_type").alias("k"), shown.alias("v")))).alias("x"))
    only = lambda kind: F.array_join(F.transform("x", lambda s: F.when(s["k"] == kind, s["v"]).otherwise("ND")), "\n")
    start = t.events.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("registration_date"), F.count(F.lit(1)).alias("n"))
    wide = attach(cells, start, ["user_id"], how="inner", keep_size=False).select("user_id", "registration_date", only("click").alias("clicks"), only("error").alias("errors"),
                                               F.array_join(F.transform("x", lambda s: s["d"]), "\n").alias("measurement_date"))
    out = longitudinal.longitudinal_table(wide, {"clicks": "click", "errors": "error"}, "user_id", drop_missing=["click", "error"])
    return out.select("user_id", "measurement", F.col("measurement_date").cast("string").alias("measurement_date"), "measurement_value", "rank",
                      F.col("diff_btw_re_and_me").cast("bigint").alias("diff_btw_re_and_me"), F.col("diff_btw_me").cast("double").alias("diff_btw_me"), "delta", "delta_per_year")


@query("J8 V5", f"""WITH {VISITS_SQL}, k AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM lon)
SELECT user_id, event_type, (user_id % 2 <> 0)::INTEGER AS odd, coalesce(gap, 0) AS gap, value FROM k WHERE n >= 14""")
def trajectories(t):
    rows = visit_rows(t).withColumn("odd", F.pmod("user_id", F.lit(2)))
    out = longitudinal.trajectories(rows, "odd", "user_id", "event_type", "diff_btw_me", "value", 14)
    return out.select("user_id", "event_type", F.col("odd").cast("int").alias("odd"), F.col("diff_btw_me").cast("bigint").alias("gap"), "value")


@query("J8", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)""")
def rows_of_frequent_groups(t):
    return joins.with_at_least(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], 12)


@query("T28", f"""WITH {VISITS_SQL}, f AS (SELECT event_type, (user_id % 2)::BIGINT AS arm, count(*) AS n, regr_slope(value, gap) AS slope, regr_intercept(value, gap) AS intercept,
 regr_r2(value, gap) AS r2, regr_sxx(value, gap) AS sxx, regr_syy(value, gap) AS syy, regr_sxy(value, gap) AS sxy FROM lon WHERE gap IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
SELECT event_type, arm, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(sqrt((syy - slope * sxy) / (n - 2) / sxx), 6) AS slope_se FROM f""")
def linear_trend(t):
    rows = visit_rows(t).withColumn("arm", F.pmod("user_id", F.lit(2)))
    return longitudinal.linear_trend(rows, "diff_btw_me", "value", ["event_type", "arm"])


BIN = "CASE WHEN {d} BETWEEN 1 AND 7 THEN '[1,7]' WHEN {d} > 7 AND {d} <= 14 THEN '(7,14]' WHEN {d} > 14 AND {d} <= 21 THEN '(14,21]' WHEN {d} > 21 AND {d} <= 28 THEN '(21,28]' WHEN {d} > 28 THEN '(28,Inf]' END"
KAPPA = """
cell AS (SELECT {by}, x, y, count(*)::DOUBLE AS n FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
tot AS (SELECT {by}, sum(n) AS nn, sum(CASE WHEN x = y THEN n ELSE 0 END) AS same FROM cell GROUP BY ALL),
rm AS (SELECT {by}, x AS l, sum(n) AS r FROM cell GROUP BY ALL), cm AS (SELECT {by}, y AS l, sum(n) AS c FROM cell GROUP BY ALL),
rc AS (SELECT {by}, sum(r * c) AS rc, sum(r * c * (r + c)) AS rcs FROM rm JOIN cm USING ({by}, l) GROUP BY ALL),
kq AS (SELECT tot.*, same / nn AS po, coalesce(rc, 0) / nn ** 2 AS pe, coalesce(rcs, 0) / nn ** 3 AS q FROM tot LEFT JOIN rc USING ({by})),
kz AS (SELECT *, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa, CASE WHEN pe + pe ** 2 - q > 1e-15 THEN (po - pe) / sqrt((pe + pe ** 2 - q) / nn) END AS z FROM kq)"""

AGREEMENT_SQL = f"""WITH rows AS (SELECT user_id AS id, event_id, event_type AS method, CAST(ts AS DATE) AS d, (value > 40)::INTEGER AS result,
  date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS cdays, date_diff('day', DATE '2024-01-05', CAST(ts AS DATE)) AS odays FROM events WHERE event_type IN ('click', 'view', 'error')),
num AS (SELECT *, row_number() OVER (PARTITION BY id, method ORDER BY event_id) AS num FROM rows),
lng AS (SELECT id, num, method, result, 'all' AS base, 'all' AS bin FROM num UNION ALL SELECT id, num, method, result, 'condition', {BIN.format(d='cdays')} FROM num
 UNION ALL SELECT id, num, method, result, 'onset', {BIN.format(d='odays')} FROM num),
pairs AS (SELECT b.method AS comparator, a.base, a.bin, a.result AS x, b.result AS y FROM lng a JOIN lng b USING (base, bin, id, num)
 WHERE a.method = 'click' AND b.method IN ('view', 'error') AND bin IS NOT NULL), {KAPPA.format(by='comparator, base, bin')}
SELECT 'click' AS target_method, comparator, base, bin, nn::BIGINT AS n, round(po * 100, 6) AS percent_agreement, round(kappa, 6) AS kappa, round(z, 5) AS z FROM kz"""


def method_rows(t):
    return t.events.filter(F.col("event_type").isin("click", "view", "error")).select(
        F.col("user_id").alias("id"), "event_id", F.col("event_type").alias("method"), F.to_date("ts").alias("method_date"),
        (F.col("value") > 40).cast("int").alias("result"), F.to_date(F.lit("2023-12-31")).alias("condition_date"),
        F.to_date(F.lit("2024-01-05")).alias("onset_date"))


@query("T19 T17 T18 J7 W4 C21", AGREEMENT_SQL, z=5)
def agreement_by_delay(t):
    return battery.agreement_battery(method_rows(t), "click", ["view", "error"], ["event_id"]).drop("p_value")


SPECIMENS_SQL = AGREEMENT_SQL.replace("lng AS (", "whole AS (SELECT id, num FROM num GROUP BY ALL HAVING count(*) = 3),\nkept AS (SELECT num.* FROM num JOIN whole USING (id, num)),\nlng AS (", 1)
SPECIMENS_SQL = SPECIMENS_SQL.replace("FROM num UNION", "FROM kept UNION").replace("FROM num\n UNION", "FROM kept\n UNION").replace("FROM num),\npairs", "FROM kept),\npairs")


def specimens(t):
    """Wide rows, one per user and record number: id, name, two dates between other cells, four cells per method (date, two values, result).
    A method without that record leaves its cells missing."""
    rows = longitudinal.number_records(method_rows(t).withColumn("value", F.col("result") + 1), ["id", "method"], ["event_id"])
    cells = [F.max(F.when(F.col("method") == m, c)).alias(f"{m}_{n}") for m in ("click", "view", "error") for n, c in (
        ("date", F.date_format("method_date", "yyyy/MM/dd")), ("e", F.col("value")), ("rdrp", F.col("value")), ("result", F.col("result")))]
    wide = rows.groupBy("id", "num").agg(F.date_format(F.max("condition_date"), "yyyy/MM/dd").alias("condition"),
                                         F.date_format(F.max("onset_date"), "yyyy/MM/dd").alias("onset"), *cells)
    return wide.select("id", F.lpad(F.col("num").cast("string"), 12, "0").alias("name"), F.lit("s").alias("site"), "condition", F.lit("t").alias("test"), "onset",
                       *[f"{m}_{n}" for m in ("click", "view", "error") for n in ("date", "e", "rdrp", "result")])


@query("T19 T17 T18 L5 R4", SPECIMENS_SQL, z=5)
def agreement_of_specimens(t):
    """The agreement battery from wide specimen rows; rows with a missing cell are left out."""
    rows = battery.method_rows(specimens(t), {"click": 7, "view": 11, "error": 15})
    return battery.agreement_battery(rows, "click", ["view", "error"], ["name"]).drop("p_value")


@query("C21", f"""SELECT bin, count(*) AS n FROM (SELECT {BIN.format(d="date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) - 2")} AS bin FROM events) GROUP BY ALL""")
def delay_bins(t):
    days = F.datediff(F.to_date("ts"), F.to_date(F.lit("2023-12-31"))) - 2
    return t.events.select(delay_bin(days).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("J7", """WITH n AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS num FROM events)
SELECT user_id, num, a.value AS target, b.value AS comparator FROM (SELECT * FROM n WHERE event_type = 'click') a
FULL JOIN (SELECT * FROM n WHERE event_type = 'view') b USING (user_id, num)""")
def method_pairs(t):
    rows = longitudinal.number_records(t.events, ["user_id", "event_type"], ["event_id"])
    return joins.pair_methods(rows, "event_type", "click", "view", ["user_id", "num"], "value")
