"""Queries: tests on means, variances, tables, regression and path model."""

from pyspark.sql import functions as F

from ..operators import means, normality, regression, tables
from ..operators.genotype import burden_frequencies
from ..operators.reshape import to_long
from ..plans import battery
from . import sqltext as Q
from .registry import query
from .visits import VISITS_SQL, visit_rows

BURDEN = """
calls AS (SELECT l_orderkey AS subject, p_brand AS gene FROM lineitem JOIN part ON l_partkey = p_partkey),
people AS (SELECT o_orderkey AS subject, o_orderstatus AS outcome FROM orders WHERE o_orderstatus IN ('F', 'O')),
cells AS (SELECT g.gene, p.subject, p.outcome, count(c.subject)::DOUBLE AS v
          FROM people p CROSS JOIN (SELECT DISTINCT gene FROM calls) g
          LEFT JOIN calls c ON c.subject = p.subject AND c.gene = g.gene GROUP BY ALL)"""


def burden_input(t):
    calls = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("subject"), F.col("p_brand").alias("gene"))
    people = t.orders.select(F.col("o_orderkey").alias("subject"), F.col("o_orderstatus").alias("outcome"))
    return burden_frequencies(calls, people, "subject", "gene", "outcome", ["F", "O"])


T_FORMULA = """
m AS (SELECT {by}, count(*) FILTER (g = 'x') AS n_x, count(*) FILTER (g = 'y') AS n_y, avg(v) FILTER (g = 'x') AS mean_x,
      avg(v) FILTER (g = 'y') AS mean_y, var_samp(v) FILTER (g = 'x') AS vx, var_samp(v) FILTER (g = 'y') AS vy
      FROM d GROUP BY ALL),
e AS (SELECT *, vx / n_x AS ex, vy / n_y AS ey FROM m),
w AS (SELECT *, (mean_x - mean_y) / sqrt(ex + ey) AS tw, (ex + ey) ** 2 / (ex ** 2 / (n_x - 1) + ey ** 2 / (n_y - 1)) AS dw,
      (mean_x - mean_y) / sqrt(((n_x - 1) * vx + (n_y - 1) * vy) / (n_x + n_y - 2) * (1.0 / n_x + 1.0 / n_y)) AS tp,
      (n_x + n_y - 2)::DOUBLE AS dp FROM e)"""

LEVENE = """
med AS (SELECT {by}, g, median(v) AS md FROM d GROUP BY ALL),
z AS (SELECT {by}, g, abs(v - md) AS z FROM d JOIN med USING ({by}, g)),
zg AS (SELECT {by}, g, count(*) AS n, avg(z) AS m, coalesce(var_samp(z), 0) * (count(*) - 1) AS s FROM z GROUP BY ALL),
zm AS (SELECT {by}, sum(n * m) / sum(n) AS gm FROM zg GROUP BY ALL),
lev AS (SELECT {by}, (count(*) - 1) AS d1, (sum(n) - count(*))::BIGINT AS d2, (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(s) / (sum(n) - count(*))) AS f
        FROM zg JOIN zm USING ({by}) GROUP BY ALL)"""


@query("A3 T1 T2 T3", f"""WITH {BURDEN},
d AS (SELECT gene, CASE outcome WHEN 'F' THEN 'x' ELSE 'y' END AS g, v FROM cells),
{T_FORMULA.format(by='gene')}, {LEVENE.format(by='gene')},
r AS (SELECT w.*, f AS levene_f, {Q.f_p('f', 'd1', 'd2')} AS levene_p FROM w JOIN lev USING (gene)),
s AS (SELECT *, levene_p >= 0.05 AS eq, CASE WHEN levene_p >= 0.05 THEN tp ELSE tw END AS t,
      CASE WHEN levene_p >= 0.05 THEN dp ELSE dw END AS v FROM r)
SELECT gene, n_x, n_y, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, round(sqrt(vx), 6) AS sd_x,
 round(sqrt(vy), 6) AS sd_y, round(levene_f, 6) AS levene_f, round(levene_p, 6) AS levene_p, eq::INTEGER AS var_equal,
 round(t, 6) AS statistic, round(v, 4) AS df, round({Q.t_p('t', 'v')}, 6) AS p_value FROM s""", df=4)
def burden_t_test_by_gene(t):
    return means.t_test_by_spread(burden_input(t), "burden", "outcome", "F", "O", ["gene"], weight="n", ready=True)


@query("A3", f"""WITH {BURDEN} SELECT gene, outcome, v::BIGINT AS burden, count(*) AS n FROM cells GROUP BY ALL""")
def burden_counts_by_gene(t):
    return burden_input(t)


@query("T1", f"""WITH d AS (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'x' ELSE 'y' END AS g, o_totalprice AS v
 FROM orders WHERE o_orderstatus IN ('F', 'O')), {T_FORMULA.format(by='o_orderpriority')}
SELECT o_orderpriority, n_x, n_y, round(mean_x, 3) AS mean_x, round(mean_y, 3) AS mean_y, round(sqrt(vx), 3) AS sd_x,
 round(sqrt(vy), 3) AS sd_y, round(tw, 6) AS statistic, round(dw, 3) AS df, round({Q.t_p('tw', 'dw')}, 6) AS p_value FROM w""",
       mean_x=3, mean_y=3, sd_x=3, sd_y=3, df=3)
def welch_t_test(t):
    return means.t_test(t.orders, "o_totalprice", "o_orderstatus", "F", "O", ["o_orderpriority"])


@query("T2", f"""WITH d AS (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'x' ELSE 'y' END AS g, value AS v FROM events),
{T_FORMULA.format(by='event_type')}
SELECT event_type, n_x, n_y, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, round(sqrt(vx), 6) AS sd_x,
 round(sqrt(vy), 6) AS sd_y, round(tp, 6) AS statistic, dp AS df, round({Q.t_p('tp', 'dp')}, 6) AS p_value FROM w""")
def pooled_t_test(t):
    return means.t_test(t.events.withColumn("g", F.pmod("user_id", F.lit(2))), "value", "g", 0, 1, ["event_type"], var_equal=True)


LONG_CUSTOMER = """
long AS (SELECT c_mktsegment AS g, 'c_acctbal' AS variable, c_acctbal AS v FROM customer
         UNION ALL SELECT c_mktsegment, 'orders', count(o_orderkey)::DOUBLE FROM customer LEFT JOIN orders ON o_custkey = c_custkey
         GROUP BY c_custkey, c_mktsegment)"""

ANOVA = """
gm AS (SELECT {by}, g, count(*) AS n, avg(v) AS m, var_samp(v) AS s2 FROM d GROUP BY ALL),
gr AS (SELECT {by}, sum(n * m) / sum(n) AS gm FROM gm GROUP BY ALL),
aov AS (SELECT {by}, count(*) - 1 AS d1, (sum(n) - count(*))::BIGINT AS d2, sum(n * (m - gr.gm) ** 2) AS ssb,
        sum((n - 1) * s2) AS ssw FROM gm JOIN gr USING ({by}) GROUP BY ALL)"""

BARTLETT = """
bart AS (SELECT {by}, count(*) - 1 AS k1,
  ((sum(n) - count(*)) * ln(sum((n - 1) * s2) / (sum(n) - count(*))) - sum((n - 1) * ln(s2)))
  / (1 + (sum(1.0 / (n - 1)) - 1.0 / (sum(n) - count(*))) / (3 * (count(*) - 1))) AS k2 FROM gm GROUP BY ALL)"""


def customer_activity(t):
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn(
        "orders", F.coalesce("orders", F.lit(0)))


def _shapiro_sql(by: str, source: str) -> str:
    m = Q.normal_quantile("((i - 0.375) / (n + 0.25))")
    c = lambda coefficients, x: Q._poly(x, coefficients)
    y = "ln(1 - w)"
    z = (f"((({y}) - {c(normality.LARGE_MEAN, 'ln(n::DOUBLE)')}) / exp({c(normality.LARGE_LOG_SD, 'ln(n::DOUBLE)')}))")
    return f"""
rk AS (SELECT {by}, v, row_number() OVER (PARTITION BY {by} ORDER BY v) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
sc AS (SELECT *, {m} AS m FROM rk),
ag AS (SELECT {by}, n, sum(m * m) AS mm, max(m) AS mn, max(CASE WHEN i = n - 1 THEN m END) AS mn1 FROM sc GROUP BY ALL),
co AS (SELECT *, {c(normality.WEIGHT_LAST, '(1 / sqrt(n))')} + mn / sqrt(mm) AS an, {c(normality.WEIGHT_SECOND, '(1 / sqrt(n))')} + mn1 / sqrt(mm) AS an1 FROM ag),
ph AS (SELECT *, (mm - 2 * mn ** 2 - 2 * mn1 ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2) AS phi FROM co),
wt AS (SELECT sc.*, CASE WHEN i = sc.n THEN an WHEN i = 1 THEN -an WHEN i = sc.n - 1 THEN an1 WHEN i = 2 THEN -an1 ELSE m / sqrt(phi) END AS a
       FROM sc JOIN ph USING ({by})),
sw AS (SELECT {by}, any_value(n) AS n, sum(a * v) ** 2 / (var_pop(v) * count(*)) AS w FROM wt GROUP BY ALL),
shap AS (SELECT *, {Q.normal_upper_p(z)} AS p FROM sw)"""


@query("T6", f"""WITH {_shapiro_sql('c_mktsegment', '(SELECT c_mktsegment, c_acctbal AS v FROM customer)')}
SELECT c_mktsegment, n, round(w, 6) AS statistic, round(p, 6) AS p_value, '' AS note FROM shap""")
def shapiro_by_group(t):
    return normality.shapiro_wilk(t.customer, "c_acctbal", ["c_mktsegment"])


@query("T3 T4 T5 T6 T7", f"""WITH {LONG_CUSTOMER}, d AS (SELECT * FROM long),
{LEVENE.format(by='variable')}, {ANOVA.format(by='variable')}, {BARTLETT.format(by='variable')}, {_shapiro_sql('variable', 'long')},
allt AS (SELECT variable, 'levene' AS test, f AS statistic, d1::DOUBLE AS df1, d2::DOUBLE AS df2, {Q.f_p('f', 'd1', 'd2')} AS p FROM lev
UNION ALL SELECT variable, 'anova', (ssb / d1) / (ssw / d2), d1, d2, {Q.f_p('((ssb / d1) / (ssw / d2))', 'd1', 'd2')} FROM aov
UNION ALL SELECT variable, 'bartlett', k2, k1, NULL, {Q.chi2_p('k2', 'k1')} FROM bart
UNION ALL SELECT variable, 'shapiro', w, NULL, NULL, p FROM shap)
SELECT variable, test, round(statistic, 6) AS statistic, df1, df2, round(p, 6) AS p_value FROM allt""")
def variance_battery(t):
    return battery.variance_battery(customer_activity(t), "c_mktsegment", ["c_acctbal", "orders"])


@query("T5", f"""WITH d AS (SELECT l_returnflag, l_linestatus AS g, l_quantity AS v FROM lineitem), {ANOVA.format(by='l_returnflag')}
SELECT l_returnflag, d1 AS df_between, d2 AS df_within, round(ssb, 3) AS ss_between, round(ssw, 2) AS ss_within,
 round(ssb / d1, 3) AS ms_between, round(ssw / d2, 5) AS ms_within, round((ssb / d1) / (ssw / d2), 6) AS statistic,
 round({Q.f_p('((ssb / d1) / (ssw / d2))', 'd1', 'd2')}, 6) AS p_value FROM aov""",
       ss_between=3, ss_within=2, ms_between=3, ms_within=5)
def anova_by_flag(t):
    return means.anova(t.lineitem, "l_quantity", "l_linestatus", ["l_returnflag"])


@query("T4", f"""WITH d AS (SELECT event_type, (user_id % 3)::VARCHAR AS g, value AS v FROM events), {ANOVA.format(by='event_type')},
{BARTLETT.format(by='event_type')}
SELECT event_type, round(k2, 6) AS statistic, k1 AS df, round({Q.chi2_p('k2', 'k1')}, 6) AS p_value FROM bart""")
def bartlett_by_event(t):
    return means.bartlett_test(t.events.withColumn("arm", F.pmod("user_id", F.lit(3))), "value", "arm", ["event_type"])


@query("T3", f"""WITH d AS (SELECT event_type, (user_id % 3)::VARCHAR AS g, value AS v FROM events), {LEVENE.format(by='event_type')}
SELECT event_type, d1 AS df_between, d2 AS df_within, round(f, 6) AS statistic, round({Q.f_p('f', 'd1', 'd2')}, 6) AS p_value FROM lev""")
def levene_by_event(t):
    return means.levene_test(t.events.withColumn("arm", F.pmod("user_id", F.lit(3))), "value", "arm", ["event_type"])


CHI = """
cell AS (SELECT {by}, r, c, count(*) AS o FROM d WHERE r IS NOT NULL AND c IS NOT NULL GROUP BY ALL),
rm AS (SELECT {by}, r, sum(o) AS rs FROM cell GROUP BY ALL), cm AS (SELECT {by}, c, sum(o) AS cs FROM cell GROUP BY ALL),
tot AS (SELECT {by}, sum(o) AS n, count(DISTINCT r) AS nr, count(DISTINCT c) AS nc FROM cell GROUP BY ALL),
ex AS (SELECT rm.*, cm.c, cs, n, nr, nc, rs * cs / n::DOUBLE AS e, coalesce(o, 0) AS o FROM rm JOIN cm USING ({by}) JOIN tot USING ({by})
       LEFT JOIN cell USING ({by}, r, c)),
chi AS (SELECT {by}, any_value(n)::BIGINT AS n, any_value(nr) AS n_rows, any_value(nc) AS n_cols,
        sum((abs(o - e) - CASE WHEN nr = 2 AND nc = 2 THEN least(0.5, abs(o - e)) ELSE 0 END) ** 2 / e) AS x,
        (any_value(nr) - 1) * (any_value(nc) - 1) AS df FROM ex GROUP BY ALL)"""
CHI_OUT = f"""n, n_rows, n_cols, CASE WHEN df > 0 THEN round(x, 5) END AS statistic, CASE WHEN df > 0 THEN df END AS df,
 CASE WHEN df > 0 THEN '' ELSE 'single level' END AS note, CASE WHEN df > 0 THEN round({Q.chi2_p('x', 'greatest(df, 1)')}, 6) END AS p_value FROM chi"""


@query("T8 A5", f"""WITH d AS (SELECT 1 AS k, o_orderstatus AS r, o_orderpriority AS c FROM orders), {CHI.format(by='k')}
SELECT {CHI_OUT}""", statistic=5)
def chisq_outcome_priority(t):
    return tables.chi_squared(t.orders, "o_orderstatus", "o_orderpriority")


@query("T8", f"""WITH d AS (SELECT 1 AS k, quality AS r, toxic AS c FROM labels), {CHI.format(by='k')} SELECT {CHI_OUT}""", statistic=5)
def chisq_yates_2x2(t):
    return tables.chi_squared(t.labels, "quality", "toxic")


@query("T9", f"""WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS y FROM orders WHERE o_orderstatus IN ('O', 'F')),
car AS (SELECT DISTINCT l_orderkey, p_type AS gene, p_brand AS coordinate FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT gene, coordinate, count(*) FILTER (y = 0) AS b, count(*) FILTER (y = 1) AS dd FROM car JOIN p ON l_orderkey = o_orderkey GROUP BY ALL),
q AS (SELECT *, (SELECT count(*) FROM p WHERE y = 0) - b AS a, (SELECT count(*) FROM p WHERE y = 1) - dd AS c FROM k),
e AS (SELECT *, abs(a - (a + b) * (a + c) / (a + b + c + dd)::DOUBLE) AS gap, (a + b + c + dd)::DOUBLE AS n FROM q),
x AS (SELECT *, (gap - least(0.5, gap)) ** 2 * n ** 3 / ((a + b)::DOUBLE * (c + dd) * (a + c) * (b + dd)) AS x FROM e)
SELECT gene, coordinate, b AS carrier_normal, dd AS carrier_patient, a AS absent_normal, c AS absent_patient, round(x, 6) AS statistic,
 1::BIGINT AS df, '' AS note, round({Q.chi2_p('x', '1')}, 6) AS p_value FROM x""")
def chisq_per_coordinate(t):
    calls = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("subject"), F.col("p_type").alias("gene"), F.col("p_brand").alias("coordinate"))
    people = t.orders.select(F.col("o_orderkey").alias("subject"), F.when(F.col("o_orderstatus") == "O", 0).when(
        F.col("o_orderstatus") == "F", 1).alias("outcome"))
    return tables.presence_chi_squared(calls, people, "subject", ["gene", "coordinate"], "outcome")


@query("T10", f"""WITH b AS (SELECT l_returnflag AS a1, l_linestatus AS a2, (l_quantity > 25)::VARCHAR AS a3 FROM lineitem),
d AS (SELECT 'returnflag' AS first, 'linestatus' AS second, a1 AS r, a2 AS c FROM b UNION ALL SELECT 'returnflag', 'large', a1, a3 FROM b
UNION ALL SELECT 'linestatus', 'large', a2, a3 FROM b), {CHI.format(by='first, second')}
SELECT first, second, {CHI_OUT}""", statistic=5)
def pairwise_association(t):
    flags = t.lineitem.select(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
                              (F.col("l_quantity") > 25).alias("large"))
    return tables.association_screen(flags, ["returnflag", "linestatus", "large"])


COHORT = """
base AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS outcome, o_totalprice, o_orderpriority,
  count(l_orderkey)::DOUBLE AS items, coalesce(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0) AS returned,
  coalesce(max(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END), 0) AS discounted, coalesce(max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END), 0) AS bulk
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def order_cohort(t):
    """One row per order with outcome, two measures and three 0/1 flags."""
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("items"), flag(F.col("l_returnflag") == "R").alias("returned"),
        flag(F.col("l_discount") > 0.08).alias("discounted"), flag(F.col("l_quantity") > 45).alias("bulk"))
    outcome = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    joined = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return joined.withColumn("outcome", outcome).na.fill(0, ["items", "returned", "discounted", "bulk"])


T_ROWS = f"""SELECT {{by}}, 't' AS test, n_x + n_y AS n, round(mean_x, 3) AS mean_x, round(mean_y, 3) AS mean_y, round(sqrt(vx), 3) AS sd_x,
 round(sqrt(vy), 3) AS sd_y, round(tw, 5) AS statistic, round(dw, 3) AS df, round({Q.t_p('tw', 'dw')}, 5) AS p_value FROM w"""
CHI_ROWS = f"""SELECT {{by}}, 'chi_squared', n, NULL, NULL, NULL, NULL, CASE WHEN df > 0 THEN round(x, 5) END, CASE WHEN df > 0 THEN df::DOUBLE END,
 CASE WHEN df > 0 THEN round({Q.chi2_p('x', 'greatest(df, 1)')}, 5) END FROM chi"""
BATTERY_DIGITS = dict(mean_x=3, mean_y=3, sd_x=3, sd_y=3, statistic=5, df=3, p_value=5)


@query("T11", f"""WITH {COHORT}, known AS (SELECT * FROM base WHERE outcome IS NOT NULL),
num AS (SELECT 'items' AS variable, outcome, items AS v FROM known UNION ALL SELECT 'o_totalprice', outcome, o_totalprice FROM known),
tt AS (WITH d AS (SELECT variable, CASE outcome WHEN 1 THEN 'x' ELSE 'y' END AS g, v FROM num), {T_FORMULA.format(by='variable')} {T_ROWS.format(by='variable')}),
cc AS (WITH d AS (SELECT 'returned' AS variable, outcome AS r, returned::VARCHAR AS c FROM known UNION ALL SELECT 'discounted', outcome, discounted::VARCHAR FROM known
 UNION ALL SELECT 'o_orderpriority', outcome, o_orderpriority FROM known), {CHI.format(by='variable')} {CHI_ROWS.format(by='variable')})
SELECT * FROM tt UNION ALL SELECT * FROM cc""", **BATTERY_DIGITS)
def condition_battery(t):
    return battery.condition_battery(order_cohort(t), "outcome", ["items", "o_totalprice"], ["returned", "discounted", "o_orderpriority"])


@query("T12 A10", f"""WITH {COHORT}, known AS (SELECT * FROM base WHERE outcome IS NOT NULL),
st AS (SELECT *, 'All' AS stratum FROM known UNION ALL SELECT *, o_orderpriority FROM known),
cond AS (SELECT 'returned' AS condition, returned AS s, * FROM st UNION ALL SELECT 'discounted', discounted, * FROM st),
tt AS (WITH d AS (SELECT condition, outcome, stratum, 'items' AS variable, CASE s WHEN 1 THEN 'x' ELSE 'y' END AS g, items AS v FROM cond),
 {T_FORMULA.format(by='condition, outcome, stratum, variable')} {T_ROWS.format(by='condition, outcome, stratum, variable')}),
cc AS (WITH d AS (SELECT condition, outcome, stratum, 'bulk' AS variable, s AS r, bulk::VARCHAR AS c FROM cond),
 {CHI.format(by='condition, outcome, stratum, variable')} {CHI_ROWS.format(by='condition, outcome, stratum, variable')})
SELECT * RENAME (stratum AS o_orderpriority) FROM (SELECT * FROM tt UNION ALL SELECT * FROM cc)""", **BATTERY_DIGITS)
def strata_battery(t):
    cohort = order_cohort(t).filter(F.col("outcome").isNotNull())
    return battery.strata_battery(cohort, ["returned", "discounted"], ["items"], ["bulk"], "outcome", "o_orderpriority", "All")


@query("T26", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_x, count(*) FILTER (o_orderstatus = 'O') AS n_y,
 round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 3) AS mean_x, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 3) AS mean_y,
 round((avg(o_totalprice) FILTER (o_orderstatus = 'O') - avg(o_totalprice) FILTER (o_orderstatus = 'F'))
 / sqrt((var_samp(o_totalprice) FILTER (o_orderstatus = 'F') + var_samp(o_totalprice) FILTER (o_orderstatus = 'O')) / 2), 6) AS d
 FROM orders GROUP BY ALL""", mean_x=3, mean_y=3)
def effect_size_by_stratum(t):
    return means.effect_size(t.orders, "o_totalprice", "o_orderstatus", "F", "O", ["o_orderpriority"])


@query("T13 P10", f"""WITH {COHORT}, c AS (SELECT
 count(*) FILTER (returned = 0 AND discounted = 0 AND outcome = 1)::DOUBLE AS a1, count(*) FILTER (returned = 0 AND discounted = 0 AND outcome = 0)::DOUBLE AS a0,
 count(*) FILTER (returned = 1 AND discounted = 0 AND outcome = 1)::DOUBLE AS b1, count(*) FILTER (returned = 1 AND discounted = 0 AND outcome = 0)::DOUBLE AS b0,
 count(*) FILTER (returned = 0 AND discounted = 1 AND outcome = 1)::DOUBLE AS c1, count(*) FILTER (returned = 0 AND discounted = 1 AND outcome = 0)::DOUBLE AS c0,
 count(*) FILTER (returned = 1 AND discounted = 1 AND outcome = 1)::DOUBLE AS d1, count(*) FILTER (returned = 1 AND discounted = 1 AND outcome = 0)::DOUBLE AS d0
 FROM base WHERE outcome IS NOT NULL),
x AS (SELECT *, ln(a1 / a0) AS la, ln(b1 / b0) AS lb, ln(c1 / c0) AS lc, ln(d1 / d0) AS ld, 1 / a1 + 1 / a0 AS va, 1 / b1 + 1 / b0 AS vb,
 1 / c1 + 1 / c0 AS vc, 1 / d1 + 1 / d0 AS vd, a1 + b1 + c1 + d1 AS s1, a0 + b0 + c0 + d0 AS s0,
 -2 * (a1 * ln(a1 / (a1 + a0)) + a0 * ln(a0 / (a1 + a0)) + b1 * ln(b1 / (b1 + b0)) + b0 * ln(b0 / (b1 + b0)) + c1 * ln(c1 / (c1 + c0))
 + c0 * ln(c0 / (c1 + c0)) + d1 * ln(d1 / (d1 + d0)) + d0 * ln(d0 / (d1 + d0))) AS dev FROM c),
y AS (SELECT '(Intercept)' AS term, la AS b, sqrt(va) AS s, * FROM x UNION ALL SELECT 'returned', lb - la, sqrt(va + vb), * FROM x
 UNION ALL SELECT 'discounted', lc - la, sqrt(va + vc), * FROM x UNION ALL SELECT 'returned:discounted', ld - lb - lc + la, sqrt(va + vb + vc + vd), * FROM x)
SELECT term, round(b, 5) AS estimate, round(s, 5) AS std_error, round(b / s, 4) AS z, round(dev, 3) AS deviance,
 round(-2 * (s1 * ln(s1 / (s1 + s0)) + s0 * ln(s0 / (s1 + s0))), 3) AS null_deviance, round(dev + 8, 3) AS aic, (s1 + s0)::BIGINT AS n,
 round({Q.normal_two_sided_p('(b / s)')}, 4) AS p_value FROM y""",
       estimate=5, std_error=5, z=4, deviance=3, null_deviance=3, aic=3, p_value=4)
def logit_interaction(t):
    return regression.logit_interaction(order_cohort(t), "outcome", "returned", "discounted").drop("note")


def _cells():
    """Outcomes by both predictors and priority."""
    n = lambda a, b, y: f"count(*) FILTER (returned = {a} AND discounted = {b} AND outcome = {y})::DOUBLE"
    cells = ", ".join(f"{n(a, b, y)} AS n{a}{b}{y}" for a in (0, 1) for b in (0, 1) for y in (0, 1))
    return f"SELECT o_orderpriority, {cells} FROM base WHERE outcome IS NOT NULL GROUP BY o_orderpriority"


@query("T13", f"""WITH {COHORT}, c AS ({_cells()}),
x AS (SELECT *, ln(n001 / n000) AS la, ln(n101 / n100) AS lb, ln(n011 / n010) AS lc, ln(n111 / n110) AS ld, 1 / n001 + 1 / n000 AS va, 1 / n101 + 1 / n100 AS vb, 1 / n011 + 1 / n010 AS vc, 1 / n111 + 1 / n110 AS vd FROM c),
y AS (SELECT o_orderpriority, unnest([{{'t': '(Intercept)', 'b': la, 's': sqrt(va)}}, {{'t': 'returned', 'b': lb - la, 's': sqrt(va + vb)}}, {{'t': 'discounted', 'b': lc - la, 's': sqrt(va + vc)}},
 {{'t': 'returned:discounted', 'b': ld - lb - lc + la, 's': sqrt(va + vb + vc + vd)}}]) AS e FROM x)
SELECT o_orderpriority, e.t AS term, round(e.b, 4) AS estimate, round(e.s, 4) AS std_error FROM y WHERE isfinite(e.b) AND isfinite(e.s)""", digits=4)
def logit_by_priority(t):
    """One fit for each priority in one job; fits without a finite solution (an empty cell) are left out by their note."""
    fits = regression.logit_interaction(order_cohort(t), "outcome", "returned", "discounted", ["o_orderpriority"])
    # of a separated fit the terms of the cells that do have both outcomes are finite as well
    return fits.filter(F.col("note").isNull() | (F.col("std_error") < 100)).select("o_orderpriority", "term", "estimate", "std_error")


@query("T13", f"""WITH {COHORT}, c AS (SELECT o_orderpriority, returned, sum(outcome)::DOUBLE AS s, count(*) - sum(outcome)::DOUBLE AS f FROM base WHERE outcome IS NOT NULL GROUP BY ALL),
x AS (SELECT o_orderpriority, max(ln(s / f)) FILTER (returned = 0) AS l0, max(ln(s / f)) FILTER (returned = 1) AS l1, max(1 / s + 1 / f) FILTER (returned = 0) AS v0, max(1 / s + 1 / f) FILTER (returned = 1) AS v1 FROM c GROUP BY ALL),
y AS (SELECT o_orderpriority, unnest([{{'t': '(Intercept)', 'b': l0, 's': sqrt(v0)}}, {{'t': 'returned', 'b': l1 - l0, 's': sqrt(v0 + v1)}}, {{'t': 'same', 'b': NULL, 's': NULL}}, {{'t': 'returned:same', 'b': NULL, 's': NULL}}]) AS e FROM x)
SELECT o_orderpriority, e.t AS term, round(e.b, 4) AS estimate, round(e.s, 4) AS std_error FROM y""", digits=4)
def logit_aliased(t):
    """A second predictor that is constant: it and the interaction have no figures."""
    fits = regression.logit_interaction(order_cohort(t).withColumn("same", F.lit(3.0)), "outcome", "returned", "same", ["o_orderpriority"])
    return fits.select("o_orderpriority", "term", "estimate", "std_error")


@query("T13", f"""WITH {COHORT} SELECT unnest(['(Intercept)', 'items', 'price', 'items:price']) AS term, 0.0::DOUBLE AS gradient, count(*) AS n FROM base WHERE outcome IS NOT NULL""", gradient=5)
def logit_gradient(t):
    """Continuous predictors: the gradient of the likelihood at the fitted coefficients, per row, is zero."""
    cohort = order_cohort(t).withColumn("price", F.col("o_totalprice") / 100000).filter(F.col("outcome").isNotNull())
    fit = regression.logit_interaction(cohort, "outcome", "items", "price").select("term", "estimate", "n")
    beta = fit.groupBy().agg(*[F.max(F.when(F.col("term") == n, F.col("estimate"))).alias(f"b{i}") for i, n in enumerate(("(Intercept)", "items", "price", "items:price"))], F.max("n").alias("n"))
    x = [F.lit(1.0), F.col("items"), F.col("price"), F.col("items") * F.col("price")]
    b = beta.first()
    margin = sum((F.lit(b[i]) * x[i] for i in range(4)), F.lit(0.0))
    residual = F.col("outcome") - 1 / (1 + F.exp(-margin))
    sums = cohort.groupBy(F.lit(b["n"]).alias("n")).agg(*[(F.sum(residual * v) / F.count(F.lit(1))).alias(n) for v, n in zip(x, ("(Intercept)", "items", "price", "items:price"))])
    return sums.unpivot(["n"], ["(Intercept)", "items", "price", "items:price"], "term", "gradient").select("term", "gradient", "n")


@query("T14", f"""WITH {COHORT}, k AS (SELECT outcome, returned, discounted, returned * discounted AS interaction FROM base WHERE outcome IS NOT NULL),
r AS (SELECT 'returned' AS flag, 'interaction' AS target, interaction AS level FROM k WHERE returned = 1 UNION ALL SELECT 'returned', 'outcome', outcome FROM k WHERE returned = 1
 UNION ALL SELECT 'discounted', 'interaction', interaction FROM k WHERE discounted = 1 UNION ALL SELECT 'discounted', 'outcome', outcome FROM k WHERE discounted = 1
 UNION ALL SELECT 'interaction', 'interaction', interaction FROM k WHERE interaction = 1 UNION ALL SELECT 'interaction', 'outcome', outcome FROM k WHERE interaction = 1)
SELECT flag, target, level, n, round(n / sum(n) OVER (PARTITION BY flag, target), 6) AS proportion
FROM (SELECT flag, target, level, count(*) AS n FROM r GROUP BY ALL)""")
def risk_flag_shares(t):
    return regression.risk_flag_shares(order_cohort(t), "outcome", "returned", "discounted")


PATH = f"""{COHORT}, k AS (SELECT outcome::DOUBLE AS y, returned::DOUBLE AS m, items AS a, o_totalprice / 100000 AS b FROM base WHERE outcome IS NOT NULL),
s AS (SELECT count(*) AS n, var_pop(y) AS yy, var_pop(m) AS mm, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(m, a) AS ma, covar_pop(m, b) AS mb,
 covar_pop(a, b) AS ab, covar_pop(y, m) AS ym, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb FROM k),
q AS (SELECT *, aa * bb - ab ** 2 AS d1, mm * (aa * bb - ab ** 2) - ma * (ma * bb - ab * mb) + mb * (ma * ab - aa * mb) AS d2 FROM s),
c AS (SELECT *, (ma * bb - mb * ab) / d1 AS p1, (mb * aa - ma * ab) / d1 AS p2,
 (ym * (aa * bb - ab ** 2) - ma * (ya * bb - ab * yb) + mb * (ya * ab - aa * yb)) / d2 AS r0,
 (mm * (ya * bb - ab * yb) - ym * (ma * bb - ab * mb) + mb * (ma * yb - ya * mb)) / d2 AS r1,
 (mm * (aa * yb - ya * ab) - ma * (ma * yb - ya * mb) + ym * (ma * ab - aa * mb)) / d2 AS r2 FROM q),
v AS (SELECT *, mm - p1 * ma - p2 * mb AS e1, yy - r0 * ym - r1 * ya - r2 * yb AS e2 FROM c),
edges AS (SELECT 'returned' AS lhs, '~' AS op, 'items' AS rhs, p1 AS est, sqrt(e1 * bb / d1 / n) AS se, p1 * sqrt(aa / mm) AS std FROM v
 UNION ALL SELECT 'returned', '~', 'price', p2, sqrt(e1 * aa / d1 / n), p2 * sqrt(bb / mm) FROM v
 UNION ALL SELECT 'returned', '~~', 'returned', e1, e1 * sqrt(2.0 / n), e1 / mm FROM v
 UNION ALL SELECT 'outcome', '~', 'returned', r0, sqrt(e2 * (aa * bb - ab ** 2) / d2 / n), r0 * sqrt(mm / yy) FROM v
 UNION ALL SELECT 'outcome', '~', 'items', r1, sqrt(e2 * (mm * bb - mb ** 2) / d2 / n), r1 * sqrt(aa / yy) FROM v
 UNION ALL SELECT 'outcome', '~', 'price', r2, sqrt(e2 * (mm * aa - ma ** 2) / d2 / n), r2 * sqrt(bb / yy) FROM v
 UNION ALL SELECT 'outcome', '~~', 'outcome', e2, e2 * sqrt(2.0 / n), e2 / yy FROM v),
pe AS (SELECT *, est / se AS z, {Q.normal_two_sided_p('(est / se)')} AS p FROM edges)"""


def path_edges(t):
    cohort = order_cohort(t).withColumn("price", F.col("o_totalprice") / 100000)
    return regression.path_model(cohort, {"returned": ["items", "price"], "outcome": ["returned", "items", "price"]})


@query("T15", f"""WITH {PATH} SELECT lhs, op, rhs, round(est, 6) AS est, round(se, 6) AS se, round(z, 5) AS z, round(std, 6) AS std, round(p, 6) AS p_value FROM pe""", z=5)
def path_model_edges(t):
    return path_edges(t)


@query("T15", f"""WITH {COHORT}, k AS (SELECT o_orderpriority, returned::DOUBLE AS m, items::DOUBLE AS a FROM base WHERE outcome IS NOT NULL),
s AS (SELECT o_orderpriority, count(*) AS n, var_pop(m) AS mm, var_pop(a) AS aa, covar_pop(m, a) AS ma FROM k GROUP BY ALL),
v AS (SELECT *, ma / aa AS b, mm - ma * ma / aa AS e FROM s)
SELECT o_orderpriority, 'returned' AS lhs, '~' AS op, 'items' AS rhs, round(b, 5) AS est, round(sqrt(e / aa / n), 5) AS se, round(b * sqrt(aa / mm), 5) AS std FROM v
UNION ALL SELECT o_orderpriority, 'returned', '~', r, NULL, NULL, NULL FROM v, (VALUES ('same'), ('twice')) x(r)
UNION ALL SELECT o_orderpriority, 'returned', '~~', 'returned', round(e, 5), round(e * sqrt(2.0 / n), 5), round(e / mm, 5) FROM v""", digits=5)
def path_model_aliased(t):
    """A model for each priority with a constant predictor and one that is twice another: their edges are NULL."""
    cohort = order_cohort(t).filter(F.col("outcome").isNotNull()).withColumns({"same": F.lit(1.0), "twice": F.col("items") * 2 + 1})
    return regression.path_model(cohort, {"returned": ["items", "same", "twice"]}, ["o_orderpriority"]).drop("z", "p_value")


@query("T16 J4 J5 U1", f"""WITH {PATH} SELECT lhs, op, rhs, round(est, 6) AS est, round(CASE WHEN abs(std) < 0.2 THEN 0 ELSE std END, 6) AS std, round(p, 6) AS p_value
 FROM pe WHERE op = '~~' OR p < 0.05""")
def path_edges_pruned(t):
    kept, _ = regression.prune_edges(path_edges(t))
    return kept.select("lhs", "op", "rhs", "est", "std", "p_value")


# groups of very few users: the integral behind the twin's p-value holds four digits there
T_ROWS4, CHI_ROWS4 = T_ROWS.replace(", 5) AS p_value", ", 4) AS p_value"), CHI_ROWS.replace(", 5) END FROM chi", ", 4) END FROM chi")
USERS = f"""{VISITS_SQL},
users AS (SELECT user_id, (user_id % 2)::INTEGER AS odd, (user_id % 3 = 0)::INTEGER AS third, (user_id % 5 < 2)::INTEGER AS outcome, 'arm ' || (user_id % 4) AS arm,
  count(*)::DOUBLE AS seen, max((value > 90)::INTEGER) AS high FROM events GROUP BY user_id),
seen AS (SELECT lon.*, odd, third, outcome, CASE WHEN gap <> 0 THEN delta / (gap / 365.0) END AS change FROM lon JOIN users USING (user_id))"""


def user_cohort(t):
    """One row per user with two conditions, an outcome, a stratum, a measure and a flag; and the users' visits."""
    mark = dict(odd=F.pmod("user_id", F.lit(2)).cast("int"), third=(F.pmod("user_id", F.lit(3)) == 0).cast("int"), outcome=(F.pmod("user_id", F.lit(5)) < 2).cast("int"))
    users = t.events.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("seen"), F.max((F.col("value") > 90).cast("int")).alias("high")).withColumns(
        {**mark, "arm": F.concat(F.lit("arm "), F.pmod("user_id", F.lit(4)).cast("string"))})
    visits = visit_rows(t).withColumns(mark).withColumnRenamed("event_type", "measurement").withColumn(
        "measurement_value", F.sqrt(F.abs("value")))  # a scale on which means of few values do not end on the digit that is rounded
    return users, visits


@query("T11 W5", f"""WITH {USERS}, num AS (SELECT 'seen' AS variable, odd, seen AS v FROM users UNION ALL SELECT event_type, odd, sqrt(abs(value)) FROM seen WHERE rank = 1),
tt AS (WITH d AS (SELECT variable, CASE odd WHEN 1 THEN 'x' ELSE 'y' END AS g, v FROM num), {T_FORMULA.format(by='variable')} {T_ROWS4.format(by='variable')}),
cc AS (WITH d AS (SELECT 'high' AS variable, odd AS r, high::VARCHAR AS c FROM users UNION ALL SELECT 'arm', odd, arm FROM users), {CHI.format(by='variable')} {CHI_ROWS4.format(by='variable')})
SELECT * FROM tt UNION ALL SELECT * FROM cc""", **{**BATTERY_DIGITS, "p_value": 4})
def condition_battery_visits(t):
    """The battery of one condition with the baseline values of every measurement."""
    users, visits = user_cohort(t)
    return battery.condition_battery(users, "odd", ["seen"], ["high", "arm"], visits=visits)


@query("T12 W3 W5", f"""WITH {USERS}, st AS (SELECT *, 'All' AS stratum FROM users UNION ALL SELECT *, arm FROM users),
rows AS (SELECT 'odd' AS condition, odd AS s, outcome, stratum, 'seen' AS variable, seen AS v FROM st UNION ALL SELECT 'third', third, outcome, stratum, 'seen', seen FROM st
 UNION ALL SELECT 'odd', odd, outcome, 'All', event_type, sqrt(abs(value)) FROM seen WHERE rank = 1 UNION ALL SELECT 'third', third, outcome, 'All', event_type, sqrt(abs(value)) FROM seen WHERE rank = 1
 UNION ALL SELECT 'odd', odd, outcome, 'All', 'change in ' || event_type, change FROM seen UNION ALL SELECT 'third', third, outcome, 'All', 'change in ' || event_type, change FROM seen),
cond AS (SELECT 'odd' AS condition, odd AS s, * FROM st UNION ALL SELECT 'third', third, * FROM st),
tt AS (WITH d AS (SELECT condition, outcome, stratum, variable, CASE s WHEN 1 THEN 'x' ELSE 'y' END AS g, v FROM rows WHERE v IS NOT NULL),
 {T_FORMULA.format(by='condition, outcome, stratum, variable')} {T_ROWS4.format(by='condition, outcome, stratum, variable')}),
cc AS (WITH d AS (SELECT condition, outcome, stratum, 'high' AS variable, s AS r, high::VARCHAR AS c FROM cond),
 {CHI.format(by='condition, outcome, stratum, variable')} {CHI_ROWS4.format(by='condition, outcome, stratum, variable')})
SELECT * RENAME (stratum AS arm) FROM (SELECT * FROM tt UNION ALL SELECT * FROM cc)""", **{**BATTERY_DIGITS, "p_value": 4})
def strata_battery_visits(t):
    """Every condition within outcome and stratum, with baseline values and yearly changes."""
    users, visits = user_cohort(t)
    return battery.strata_battery(users, ["odd", "third"], ["seen"], ["high"], "outcome", "arm", "All", visits)
