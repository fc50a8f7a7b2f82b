"""Queries: registry joins, keys, matching, samples."""

from pyspark.sql import functions as F

from ..operators import joins, matching, sampling
from .registry import query
from .sqltext import uniform

SIDES_SQL = """
x AS (SELECT c_custkey::VARCHAR AS k, c_name AS name, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS seg, 'a' || chr(10) || c_nationkey AS note, c_nationkey AS xonly FROM customer WHERE c_nationkey < 18),
y AS (SELECT c_custkey::VARCHAR AS k, c_name AS name, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_nationkey || chr(10) || 'b' AS note, c_acctbal AS yonly FROM customer WHERE c_nationkey >= 6)"""


def sides(t):
    """Two overlapping halves of the customer table with gaps and packed notes."""
    c = t.customer
    gap = lambda m: F.when(F.pmod("c_nationkey", F.lit(m)) != 0, F.col("c_mktsegment")).alias("seg")
    key, name, nation = F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string")
    x = c.filter("c_nationkey < 18").select(key, name, gap(3), F.concat(F.lit("a\n"), nation).alias("note"), F.col("c_nationkey").alias("xonly"))
    y = c.filter("c_nationkey >= 6").select(key, name, gap(4), F.concat(nation, F.lit("\nb")).alias("note"), F.col("c_acctbal").alias("yonly"))
    return x, y


@query("J3 C27 C28 U2", f"""WITH {SIDES_SQL} SELECT coalesce(x.k, y.k) AS k, coalesce(x.name, y.name) AS name, coalesce(x.seg, y.seg) AS seg,
 CASE WHEN x.k IS NULL THEN y.note WHEN y.k IS NULL THEN x.note ELSE x.note || chr(10) || 'b' END AS note, xonly::DOUBLE AS xonly, yonly FROM x FULL JOIN y ON x.k = y.k""")
def coalesce_join_registries(t):
    x, y = sides(t)
    return joins.coalesce_join(x, y, ["k"]).withColumn("xonly", F.col("xonly").cast("double"))


@query("J2 C27", f"""WITH {SIDES_SQL} SELECT k, coalesce(x.name, y.name) AS name, coalesce(x.seg, y.seg) AS seg, coalesce(x.note, y.note) AS note FROM x FULL JOIN y USING (k)""")
def full_join_first_known(t):
    x, y = sides(t)
    return joins.full_join_first_known(x.drop("xonly"), y.drop("yonly"), ["k"])


@query("J1", """WITH l AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p FROM orders),
r AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderkey, l.p, n FROM l LEFT JOIN r ON l.p IS NOT DISTINCT FROM r.p""")
def left_join_missing_keys(t):
    p = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("p")
    left = t.orders.select("o_orderkey", p)
    return joins.left_join(left, t.orders.groupBy(p).agg(F.count(F.lit(1)).alias("n")), ["p"], na_matches=True)


@query("J4", "SELECT c_custkey, c_nationkey FROM customer WHERE (c_nationkey, c_custkey % 25) IN (SELECT s_suppkey % 25, s_nationkey FROM supplier)")
def semi_join_crossed(t):
    left = t.customer.select("c_custkey", "c_nationkey", F.pmod("c_custkey", F.lit(25)).cast("int").alias("other"))
    right = t.supplier.select(F.col("s_nationkey").alias("a"), F.pmod("s_suppkey", F.lit(25)).cast("int").alias("b"))
    return joins.semi_join(left, right, [("c_nationkey", "b"), ("other", "a")]).drop("other")


@query("J5", "SELECT DISTINCT user_id, event_type FROM events EXCEPT SELECT user_id, event_type FROM events WHERE value > 120")
def anti_join_shared(t):
    return joins.anti_join(t.events.select("user_id", "event_type").distinct(), t.events.filter("value > 120").select("user_id", "event_type"))


@query("J10", """SELECT o_orderkey, concept FROM orders LEFT JOIN (VALUES ('1-URGENT', 'now'), ('2-HIGH', 'soon'), ('5-LOW', 'later')) v(p, concept) ON o_orderpriority = p""")
def lookup_enrichment(t):
    from ..operators.reshape import constant_table
    lookup = constant_table(t.spark, {"1-URGENT": ["now"], "2-HIGH": ["soon"], "5-LOW": ["later"]}, ["o_orderpriority", "concept"])
    return joins.enrich(t.orders.select("o_orderkey", "o_orderpriority"), lookup, ["o_orderpriority"]).drop("o_orderpriority")


LINK_SQL = """
a AS (SELECT c_custkey::VARCHAR AS patient_id, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS gender, 'M' || c_custkey AS master_no FROM customer WHERE c_nationkey < 18),
b AS (SELECT c_custkey::VARCHAR AS patient_id, c_name AS name, c_mktsegment AS gender, 'C' || c_custkey AS registry_no FROM customer WHERE c_nationkey >= 6),
k1 AS (SELECT 'M' || c_custkey AS master_no, c_mktsegment AS gender, 'K' || c_custkey AS karyotype_no FROM customer WHERE c_nationkey BETWEEN 3 AND 20),
k2 AS (SELECT c_name AS name, c_mktsegment AS gender, 'G' || c_custkey AS ngs_2_no FROM customer WHERE c_nationkey > 10),
ab AS (SELECT patient_id, coalesce(a.name, b.name) AS name, coalesce(a.gender, b.gender) AS gender, master_no, registry_no FROM a FULL JOIN b USING (patient_id)),
abk AS (SELECT patient_id, name, coalesce(ab.gender, k1.gender) AS gender, coalesce(ab.master_no, k1.master_no) AS master_no, registry_no, karyotype_no FROM ab FULL JOIN k1 ON ab.master_no IS NOT DISTINCT FROM k1.master_no),
al AS (SELECT patient_id, coalesce(abk.name, k2.name) AS name, coalesce(abk.gender, k2.gender) AS gender, master_no, registry_no, karyotype_no, ngs_2_no FROM abk FULL JOIN k2 ON abk.name IS NOT DISTINCT FROM k2.name AND abk.gender IS NOT DISTINCT FROM k2.gender)"""


def registries(t):
    c = t.customer
    key = lambda p: F.concat(F.lit(p), F.col("c_custkey").cast("string"))
    pid, name, sex = F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("gender")
    a = c.filter("c_nationkey < 18").select(pid, name, F.when(F.pmod("c_nationkey", F.lit(2)) == 0, F.col("c_mktsegment")).alias("gender"), key("M").alias("master_no"))
    b = c.filter("c_nationkey >= 6").select(pid, name, sex, key("C").alias("registry_no"))
    k1 = c.filter("c_nationkey BETWEEN 3 AND 20").select(key("M").alias("master_no"), sex, key("K").alias("karyotype_no"))
    k2 = c.filter("c_nationkey > 10").select(name, sex, key("G").alias("ngs_2_no"))
    return a, b, k1, k2


@query("J9 J2", f"""WITH {LINK_SQL} SELECT patient_id, name, gender, master_no, registry_no, karyotype_no, ngs_2_no,
 row_number() OVER (ORDER BY patient_id NULLS LAST, master_no NULLS LAST, registry_no NULLS LAST, karyotype_no NULLS LAST, ngs_2_no NULLS LAST)::VARCHAR AS key_id FROM al""")
def link_keys(t):
    a, b, k1, k2 = registries(t)
    return joins.link_registries(a, [(b, ["patient_id"]), (k1, ["master_no"]), (k2, ["name", "gender"])],
                                 ["patient_id", "master_no", "registry_no", "karyotype_no", "ngs_2_no"], na_matches=True)


FIVE_SQL = """
d AS (SELECT *, (DATE '1940-01-01' + (c_custkey % 20000)::INTEGER)::VARCHAR AS born FROM customer),
a AS (SELECT c_custkey::VARCHAR AS patient_id, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS gender, born AS birth_date, 'M' || c_custkey AS master_no FROM d WHERE c_nationkey < 18),
b AS (SELECT c_custkey::VARCHAR AS patient_id, c_name AS name, c_mktsegment AS gender, born AS birth_date, p || c_custkey AS registry_no FROM d JOIN (VALUES ('C'), ('D')) v(p) ON p = 'C' OR c_custkey % 7 = 0 WHERE c_nationkey >= 6),
k1 AS (SELECT 'M' || c_custkey AS master_no, c_mktsegment AS gender, 'K' || c_custkey AS karyotype_no FROM d WHERE c_nationkey BETWEEN 3 AND 20),
k2 AS (SELECT c_name AS name, c_mktsegment AS gender, CASE WHEN c_custkey % 5 > 0 THEN born END AS birth_date, 'G' || c_custkey AS ngs_2_no FROM d WHERE c_nationkey > 10),
k3 AS (SELECT CASE WHEN c_custkey % 3 > 0 THEN 'C' || c_custkey END AS registry_no, c_name AS name, c_mktsegment AS gender, 'L' || (c_custkey // 2) AS karyotype_2_no FROM d WHERE c_nationkey BETWEEN 8 AND 22),
ab AS (SELECT patient_id, coalesce(a.name, b.name) AS name, coalesce(a.gender, b.gender) AS gender, coalesce(a.birth_date, b.birth_date) AS birth_date, master_no, registry_no FROM a FULL JOIN b USING (patient_id)),
abk AS (SELECT patient_id, name, coalesce(ab.gender, k1.gender) AS gender, birth_date, coalesce(ab.master_no, k1.master_no) AS master_no, registry_no, karyotype_no FROM ab FULL JOIN k1 ON ab.master_no = k1.master_no),
abg AS (SELECT patient_id, coalesce(abk.name, k2.name) AS name, coalesce(abk.gender, k2.gender) AS gender, coalesce(abk.birth_date, k2.birth_date) AS birth_date, master_no, registry_no, karyotype_no, ngs_2_no
 FROM abk FULL JOIN k2 ON abk.name = k2.name AND abk.gender = k2.gender AND abk.birth_date = k2.birth_date),
al AS (SELECT patient_id, coalesce(abg.name, k3.name) AS name, coalesce(abg.gender, k3.gender) AS gender, birth_date, master_no, coalesce(abg.registry_no, k3.registry_no) AS registry_no, karyotype_no, ngs_2_no, karyotype_2_no
 FROM abg FULL JOIN k3 ON abg.registry_no = k3.registry_no),
keyed AS (SELECT *, row_number() OVER (ORDER BY patient_id NULLS LAST, master_no NULLS LAST, registry_no NULLS LAST, karyotype_no NULLS LAST, ngs_2_no NULLS LAST, karyotype_2_no NULLS LAST, name NULLS LAST)::VARCHAR AS key_id FROM al)"""

IDENTIFIERS = ["patient_id", "master_no", "registry_no", "karyotype_no", "ngs_2_no", "karyotype_2_no"]


def five_registries(t):
    """Masters, a second registry where some are listed twice, two karyotype lists and a sequencing list with missing birth dates."""
    key = F.col("c_custkey")
    text = lambda p, k=key: F.concat(F.lit(p), k.cast("string"))
    born = F.date_add(F.lit("1940-01-01").cast("date"), F.pmod(key, F.lit(20000)).cast("int")).cast("string")
    mod = lambda m: F.pmod(key, F.lit(m))
    pid, name, sex = key.cast("string").alias("patient_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("gender")
    c = t.customer
    a = c.filter("c_nationkey < 18").select(pid, name, F.when(F.pmod("c_nationkey", F.lit(2)) == 0, F.col("c_mktsegment")).alias("gender"), born.alias("birth_date"), text("M").alias("master_no"))
    twice = F.explode(F.when(mod(7) == 0, F.array(text("C"), text("D"))).otherwise(F.array(text("C")))).alias("registry_no")
    b = c.filter("c_nationkey >= 6").select(pid, name, sex, born.alias("birth_date"), twice)
    k1 = c.filter("c_nationkey BETWEEN 3 AND 20").select(text("M").alias("master_no"), sex, text("K").alias("karyotype_no"))
    k2 = c.filter("c_nationkey > 10").select(name, sex, F.when(mod(5) > 0, born).alias("birth_date"), text("G").alias("ngs_2_no"))
    k3 = c.filter("c_nationkey BETWEEN 8 AND 22").select(F.when(mod(3) > 0, text("C")).alias("registry_no"), name, sex, text("L", F.floor(key / 2)).alias("karyotype_2_no"))
    return joins.link_registries(a, [(b, ["patient_id"]), (k1, ["master_no"]), (k2, ["name", "gender", "birth_date"]), (k3, ["registry_no"])], [*IDENTIFIERS, "name"])


@query("J9 J2", f"WITH {FIVE_SQL} SELECT * FROM keyed")
def link_keys_of_five(t):
    """All four joins, with the birth date; missing keys link nothing."""
    return five_registries(t)


@query("J9", f"""WITH RECURSIVE {FIVE_SQL}, ids AS ({' UNION ALL '.join(f"SELECT key_id::BIGINT AS k, '{c}' AS kind, {c} AS value FROM keyed WHERE {c} IS NOT NULL" for c in IDENTIFIERS)}),
e AS (SELECT DISTINCT x.k AS u, y.k AS v FROM ids x JOIN ids y USING (kind, value)),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
p AS (SELECT u, min(v) AS person_id FROM r GROUP BY u), n AS (SELECT *, count(*) OVER (PARTITION BY person_id) AS n_keys FROM p)
SELECT u::VARCHAR AS key_id, person_id, n_keys FROM n WHERE n_keys > 1""")
def people_with_several_keys(t):
    """People whom the cascade gave more than one key, found by the identifiers their rows share."""
    from ..operators import linkage
    return linkage.people_with_several_keys(linkage.with_person(five_registries(t), "key_id", IDENTIFIERS)).select("key_id", "person_id", "n_keys")


MATCH_SQL = """
g AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_acctbal > 7000 THEN 1 WHEN c_acctbal < 3000 THEN 0 END AS y, c_acctbal FROM customer),
cell AS (SELECT c_nationkey, c_mktsegment, count(*) FILTER (y = 1) AS t, count(*) FILTER (y = 0) AS c FROM g GROUP BY ALL HAVING count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0),
num AS (SELECT *, row_number() OVER (ORDER BY c_nationkey, c_mktsegment) AS subclass, (SELECT sum(c) / sum(t)::DOUBLE FROM cell) AS b FROM cell),
m AS (SELECT g.*, subclass, CASE WHEN y = 1 THEN 1 ELSE t / c::DOUBLE * b END AS weights FROM g JOIN num USING (c_nationkey, c_mktsegment) WHERE y IN (0, 1))"""


def match_input(t):
    y = F.when(F.col("c_acctbal") > 7000, 1).when(F.col("c_acctbal") < 3000, 0)
    return t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", y.alias("y"))


def matched(t):
    return matching.exact_match(match_input(t), "y", ["c_nationkey", "c_mktsegment"])


@query("J11", f"WITH {MATCH_SQL} SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, y, subclass, round(weights, 6) AS weights FROM m")
def exact_match(t):
    return matched(t)


@query("T27", f"""WITH {MATCH_SQL}, s AS (SELECT stddev_samp(c_acctbal) AS sd FROM g WHERE y = 1),
u AS (SELECT 'all' AS stage, y, c_acctbal AS x, 1.0 AS w FROM g UNION ALL SELECT 'matched', y, c_acctbal, weights FROM m),
a AS (SELECT stage, count(*) FILTER (y = 1) AS n_treated, count(*) FILTER (y = 0) AS n_control, sum(x * w) FILTER (y = 1) / sum(w) FILTER (y = 1) AS mt, sum(x * w) FILTER (y = 0) / sum(w) FILTER (y = 0) AS mc FROM u GROUP BY ALL)
SELECT stage, n_treated, n_control, round(mt, 4) AS mean_treated, round(mc, 4) AS mean_control, round((mt - mc) / sd, 6) AS std_mean_diff FROM a, s""", mean_treated=4, mean_control=4)
def match_balance(t):
    return matching.balance(match_input(t), matched(t), "y", "c_acctbal")


@query("H4 A4", f"WITH {MATCH_SQL}, k AS (SELECT subclass, y, count(*) AS n FROM m GROUP BY ALL) SELECT subclass, y, n, round(1 - n / sum(n) OVER (PARTITION BY subclass), 6) AS weights FROM k")
def selection_weights(t):
    return matching.selection_weights(matched(t), ["subclass"], "y")


@query("H2", f"""WITH {MATCH_SQL}, k AS (SELECT subclass, y, count(*) AS n FROM m GROUP BY ALL), w AS (SELECT subclass, y, 1 - n / sum(n) OVER (PARTITION BY subclass) AS w FROM k),
s AS (SELECT c_custkey, y, subclass, row_number() OVER (PARTITION BY y ORDER BY -ln({uniform(1, 'c_custkey')}) / w, c_custkey) AS r FROM m JOIN w USING (subclass, y) WHERE w > 0)
SELECT c_custkey, y, subclass FROM s WHERE r <= 20""")
def weighted_sample(t):
    m = matched(t).drop("weights")
    w = matching.selection_weights(m, ["subclass"], "y").drop("n")
    rows = joins.left_join(m, w, ["subclass", "y"])
    return sampling.weighted_sample(rows, ["y"], "weights", 20, ["c_custkey"]).select("c_custkey", "y", "subclass")


@query("H1", f"""SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {uniform(20201012, 'c_custkey')}, c_custkey) AS r FROM customer) WHERE r <= 25""")
def stratified_sample(t):
    return sampling.stratified_sample(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], 25, ["c_custkey"])


@query("S14", """SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2)""")
def incremental_anti(t):
    from ..sources.manifest import completed, pending
    outputs = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", F.col("l_quantity").alias("length"))
    return pending(t.orders.select("o_orderkey"), completed(outputs, ["o_orderkey"], "l_returnflag", ["A", "R"]), ["o_orderkey"])


@query("P3 L5 L9 C3 C6 C14 C26", """SELECT 'K-' || c_custkey AS karyotype_no, CASE WHEN c_nationkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender, (20 + c_custkey % 60)::INTEGER AS age, true AS karyotype,
 CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END::DOUBLE AS turner FROM customer WHERE c_custkey % 10 <> 0""")
def karyotype_list(t):
    """Karyotype rows: sex and age in one cell, ids behind a quote, flags with gaps, rows without an id."""
    from ..plans.cohort import karyotype_rows
    key = F.col("c_custkey")
    raw = t.customer.select(
        F.when(F.pmod(key, F.lit(10)) != 0, F.concat(F.lit("'K-"), key.cast("string"))).alias("code"),
        F.concat(F.when(F.pmod("c_nationkey", F.lit(2)) == 0, "M").otherwise("F"), F.lit("/"), (20 + F.pmod(key, F.lit(60))).cast("string")).alias("sa"),
        F.when(F.pmod(key, F.lit(3)) == 0, "1").alias("turner"))
    return karyotype_rows(raw, {"code": "karyotype_no", "sa": "sex_age"}, ["turner"], "karyotype_no")


@query("J1", """SELECT o_orderkey, n, CASE WHEN n IS NOT NULL AND c_custkey IS NOT NULL THEN c_custkey::VARCHAR END AS key_id
 FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'R' || o_custkey END AS n FROM orders) LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) ON n = 'R' || c_custkey""")
def person_key_by_number(t):
    """The person key by registry number: unknown and missing numbers keep none."""
    from ..plans.cohort import with_key
    number = lambda c: F.concat(F.lit("R"), F.col(c).cast("string"))
    keys = t.customer.select(F.when(F.col("c_nationkey") < 20, number("c_custkey")).alias("n"), F.col("c_custkey").cast("string").alias("key_id"))
    return with_key(t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", number("o_custkey")).alias("n")), keys, "n")


@query("L8 L9 J2 C6", """WITH s AS (SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer WHERE c_nationkey % 5 = 0 OR c_custkey IN (7, 8)),
a AS (SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_acctbal > 5000)
SELECT coalesce(s.id, a.id) AS id, name, CASE WHEN a.id IS NULL THEN '0' ELSE '1' END AS receive, CASE WHEN a.id IS NULL THEN '0' ELSE '1' END AS answer FROM s FULL JOIN a USING (id)""")
def staff_survey(t):
    """Staff by position or listed id, joined with who received and answered."""
    from ..plans.cohort import survey_staff
    key = F.col("c_custkey").cast("string")
    staff = t.customer.select(key.alias("id"), F.col("c_name").alias("name"), F.when(F.pmod("c_nationkey", F.lit(5)) == 0, "부교수").otherwise("직원").alias("position"), F.lit("없음").alias("duty"))
    answers = t.customer.filter("c_acctbal > 5000").select(F.concat(key, F.lit(".0")).alias("id"))
    return survey_staff(staff, answers, ["7", "8"]).select("id", "name", "receive", "answer")
