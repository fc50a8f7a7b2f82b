"""Queries: variant grids, presence, combinations, carriers, frequencies."""

from pyspark.sql import functions as F

from ..operators import genotype, reshape
from ..operators.columns import drop_rare_columns, drop_rare_features
from ..operators.filters import exclude_listed
from .registry import query
from .sqltext import uniform

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

CALLS_SQL = """calls AS (SELECT l_orderkey, p_type, p_brand, p_size, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def calls(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))


def presence(t, item="p_type"):
    """Long presence: 1 for every item type in an order; cheap lines stand for normal calls."""
    rows = calls(t).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("dementia"),
        F.col(item).alias("Coordinate"), F.when(F.col("l_quantity") <= 10, "normal").otherwise("A>G").alias("Variant"))
    return reshape.presence_rows(rows, "id", "dementia", "Coordinate", "Variant")


PRESENCE_SQL = """pres AS (SELECT l_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS dementia, {item} AS c,
 max(CASE WHEN l_quantity <= 10 THEN 0 ELSE 1 END) AS present FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"""


@query("R5", f"WITH {PRESENCE_SQL.format(item='p_type')} SELECT id, dementia, c AS \"Coordinate\", present FROM pres")
def presence_long(t):
    return presence(t)


@query("R5 A7 R1 R2", f"""WITH {PRESENCE_SQL.format(item='p_type')} SELECT id, dementia, {', '.join(f"max(CASE WHEN c = '{x}' THEN present ELSE 0 END) AS coordinate_{x}" for x in TYPES)},
 sum(present)::INTEGER AS n_variant FROM pres GROUP BY ALL""")
def presence_matrix(t):
    return reshape.presence_matrix(presence(t), "id", "dementia", "Coordinate", TYPES)


@query("R5 A7", f"""WITH {PRESENCE_SQL.format(item='p_type')}, lv AS (SELECT c, row_number() OVER (ORDER BY c) AS level FROM (SELECT DISTINCT c FROM pres))
SELECT id, dementia, coalesce(string_agg(CASE WHEN present = 1 THEN level END, ',' ORDER BY level), '') AS levels, sum(present)::INTEGER AS n_variant FROM pres JOIN lv USING (c) GROUP BY ALL""")
def presence_sparse(t):
    """Levels found in the data, rows that list the present ones."""
    long = presence(t)
    rows = reshape.presence_sparse(long, "id", "dementia", "Coordinate", reshape.presence_levels(long, "Coordinate"))
    return rows.withColumn("levels", F.array_join("levels", ","))


@query("R5 A7", f"""WITH {PRESENCE_SQL.format(item='p_type')} SELECT id, dementia, max(CASE WHEN c = 'ECONOMY' THEN present ELSE 0 END) AS coordinate_ECONOMY,
 max(CASE WHEN c = 'PROMO' THEN present ELSE 0 END) AS coordinate_PROMO, sum(present)::INTEGER AS n_variant FROM pres GROUP BY ALL""")
def presence_of_two(t):
    """Two coordinates shown, the burden over all of them."""
    return reshape.presence_matrix(presence(t), "id", "dementia", "Coordinate", ["ECONOMY", "PROMO"])


@query("V6 A7", f"WITH {PRESENCE_SQL.format(item='p_type')}, b AS (SELECT id, sum(present)::BIGINT AS n_variant FROM pres GROUP BY id) SELECT n_variant, count(*) AS n FROM b GROUP BY ALL")
def burden_distribution(t):
    from ..operators.charts import burden_distribution as table
    return table(reshape.burden(presence(t), "id", "dementia"))


@query("J6 L9", """WITH obs AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT c_custkey, p AS o_orderpriority, coalesce(n, 0) AS n FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders)
LEFT JOIN obs ON o_custkey = c_custkey AND o_orderpriority = p""")
def grid_defaults(t):
    from ..operators.joins import fill_grid, grid
    observed = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    cells = grid(t.customer.select("c_custkey"), t.orders.select("o_orderpriority").distinct())
    return fill_grid(cells, observed, ["c_custkey", "o_orderpriority"], {"n": 0})


FORM1_SQL = """subj AS (SELECT (CASE WHEN c_nationkey < 12 THEN 'N-' ELSE 'P-' END) || c_custkey AS id, c_custkey FROM customer),
o AS (SELECT o_custkey, o_orderpriority AS coord, min(o_orderkey) AS k FROM orders GROUP BY ALL),
raw AS (SELECT id, coord, CASE WHEN k % 2 = 0 THEN 'A>G' ELSE 'C>G/G' END AS variant, CASE WHEN k % 3 = 0 THEN 'hom' ELSE 'het' END AS genotype, 'yes' AS exonic,
 CASE WHEN k % 5 = 0 THEN 'missense' ELSE 'synonymous' END AS consequence FROM o JOIN subj ON c_custkey = o_custkey)"""


def form1(t):
    subjects = t.customer.select(F.concat(F.when(F.col("c_nationkey") < 12, "N_").otherwise("P_"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey")
    first = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    rows = first.join(subjects, F.col("o_custkey") == F.col("c_custkey"))
    pick = lambda m, a, b: F.when(F.pmod("k", F.lit(m)) == 0, a).otherwise(b)
    table = rows.select("id", F.lit("TOP").alias("Gene"), F.col("o_orderpriority").alias("Coordinate"), pick(2, "A>G", "C>G/G").alias("Variant"),
                        pick(3, "hom", "het").alias("Genotype"), F.lit("yes").alias("Exonic"), pick(5, "missense", "synonymous").alias("Consequence"))
    return table, subjects.select("id")


@query("G1 J6 R2 C3 C30", f"""WITH {FORM1_SQL}, g AS (SELECT id, p AS coord FROM subj CROSS JOIN (SELECT DISTINCT coord AS p FROM raw))
SELECT id, 'TOP' AS "Gene", coord AS "Coordinate", coalesce(variant, 'normal') AS "Variant",
 CASE genotype WHEN 'hom' THEN 'homozygous mutant type' WHEN 'het' THEN 'heterozygous mutant type' ELSE 'homozygous wild type' END AS "Genotype",
 coalesce(exonic, 'no') AS "Exonic", coalesce((consequence = 'missense')::INTEGER, 0) AS missense, coalesce((consequence = 'synonymous')::INTEGER, 0) AS synonymous,
 CASE WHEN id LIKE 'N%' THEN 0 ELSE 1 END AS dementia FROM g LEFT JOIN raw USING (id, coord)""")
def variant_table(t):
    rows, subjects = form1(t)
    return genotype.variant_table(rows, subjects, ["missense", "synonymous"], "TOP")


@query("G6 C29 C30", f"""WITH {FORM1_SQL}, g AS (SELECT id, variant FROM subj LEFT JOIN (SELECT * FROM raw WHERE coord = '1-URGENT') USING (id)),
a AS (SELECT id, coalesce(variant, 'normal') AS v, CASE WHEN length(id) % 3 = 0 THEN 'E4/E4' WHEN length(id) % 3 = 1 THEN 'E3/E4' ELSE 'E3/E3' END AS apoe FROM g)
SELECT id, CASE WHEN id LIKE 'N%' THEN 0 ELSE 1 END AS dementia, CASE WHEN v <> 'normal' AND contains(substr(v, 3), 'G') THEN 1 ELSE 0 END AS g_carrier,
 CASE WHEN v <> 'normal' AND contains(substr(v, 3), 'G/G') THEN 1 ELSE 0 END AS g_hom, contains(apoe, 'E4')::INTEGER AS e4_carrier, (apoe = 'E4/E4')::INTEGER AS e4_hom FROM a""")
def carrier_table(t):
    rows, subjects = form1(t)
    table = genotype.variant_table(rows, subjects, [], "TOP")
    kind = F.pmod(F.length("id"), F.lit(3))
    table = table.withColumn("apoe", F.when(kind == 0, "E4/E4").when(kind == 1, "E3/E4").otherwise("E3/E3"))
    return genotype.carrier_table(table, "1-URGENT")


GRID_SQL = f"""WITH p AS (SELECT o_orderkey, (CASE WHEN o_orderstatus = 'O' THEN 'N' ELSE 'P' END) || o_custkey AS m FROM orders),
c AS (SELECT m AS master_no, l_returnflag AS gene, l_linenumber AS coordinate, max(CASE WHEN l_quantity > 40 THEN '.' ELSE 'exon' END) AS ef, max(CASE WHEN l_discount > 0.05 THEN 'hom' ELSE 'het' END) AS gt
 FROM lineitem JOIN p ON l_orderkey = o_orderkey GROUP BY ALL),
g AS (SELECT master_no, gene, coordinate FROM (SELECT DISTINCT master_no FROM c) CROSS JOIN (SELECT DISTINCT gene, coordinate FROM c))
SELECT gene, coordinate, exonic_func, genotype, "Alt", dementia, count(*) AS n FROM (SELECT gene, coordinate, CASE WHEN ef = '.' THEN 'intronic SNV' ELSE coalesce(ef, 'normal') END AS exonic_func,
 CASE gt WHEN 'hom' THEN 'homozygous mutant type' WHEN 'het' THEN 'heterozygous mutant type' ELSE 'homozygous wild type' END AS genotype,
 CASE WHEN ef IS NULL THEN 'A' ELSE 'T' END AS "Alt", CASE WHEN master_no LIKE 'N%' THEN 0 ELSE 1 END AS dementia FROM g LEFT JOIN c USING (master_no, gene, coordinate)) GROUP BY ALL"""


def annotated_calls(t):
    people = t.orders.select("o_orderkey", F.concat(F.when(F.col("o_orderstatus") == "O", "N").otherwise("P"), F.col("o_custkey").cast("string")).alias("master_no"))
    rows = t.lineitem.join(people, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.groupBy("master_no", F.col("l_returnflag").alias("gene"), F.col("l_linenumber").alias("coordinate")).agg(
        F.max(F.when(F.col("l_quantity") > 40, ".").otherwise("exon")).alias("exonic_func"),
        F.max(F.when(F.col("l_discount") > 0.05, "hom").otherwise("het")).alias("genotype"))
    rows = rows.withColumns({"Ref": F.lit("A"), "Alt": F.lit("T"), "func": F.lit("f")})
    return rows


@query("G2 J6 C4", GRID_SQL)
def annotated_grid(t):
    rows = annotated_calls(t)
    table = genotype.annotated_table(rows, rows.select("master_no"))
    return table.groupBy("gene", "coordinate", "exonic_func", "genotype", "Alt", "dementia").agg(F.count(F.lit(1)).alias("n"))


@query("G2 A3 C4", GRID_SQL)
def annotated_counts(t):
    """The same counts from the sparse calls."""
    rows = annotated_calls(t)
    return genotype.annotated_counts(rows, rows.select("master_no"))


SETS_SQL = """{presence}, it AS (SELECT DISTINCT id, c FROM pres WHERE present = 1), sz AS (SELECT id, count(*) AS k FROM it GROUP BY id),
combo AS (SELECT a.id, 3 AS k, a.c || '_' || b.c || '_' || d.c AS item_set FROM it a JOIN it b ON a.id = b.id AND a.c < b.c JOIN it d ON d.id = a.id AND b.c < d.c
UNION ALL SELECT a.id, 2, a.c || '_' || b.c FROM it a JOIN it b ON a.id = b.id AND a.c < b.c JOIN sz ON sz.id = a.id WHERE sz.k = 2
UNION ALL SELECT it.id, 1, c FROM it JOIN sz ON sz.id = it.id WHERE sz.k = 1)"""


def sets_sql(item):
    return SETS_SQL.format(presence=PRESENCE_SQL.format(item=item))


BRAND_SETS = sets_sql("p_brand")


@query("G3", f"WITH {BRAND_SETS} SELECT id, k, item_set FROM combo")
def combos_k123(t):
    return genotype.subject_combinations(presence(t, "p_brand"), "id", "Coordinate")


@query("G4 P9", f"WITH {BRAND_SETS} SELECT k, item_set, count(*) AS support FROM combo GROUP BY ALL HAVING count(*) > 5")
def combo_support(t):
    return genotype.combination_support(presence(t, "p_brand"), "id", "Coordinate", 5)


@query("G4", f"WITH {BRAND_SETS}, s AS (SELECT k, item_set FROM combo GROUP BY ALL HAVING count(*) > 5) SELECT id, k, item_set FROM combo SEMI JOIN s USING (k, item_set)")
def combos_with_support(t):
    return genotype.subject_combinations(presence(t, "p_brand"), "id", "Coordinate", 5)


@query("G5 C29", f"""WITH {PRESENCE_SQL.format(item='p_type')} SELECT id, dementia, CASE WHEN c IN ('ECONOMY', 'PROMO', 'SMALL') THEN 'haplotype' ELSE c END AS "Coordinate", max(present) AS present FROM pres GROUP BY ALL""")
def haplotype_presence(t):
    return genotype.collapse_haplotype(presence(t), "id", "dementia", "Coordinate", ["ECONOMY", "PROMO", "SMALL"])


@query("G7 A4 A1 R1", f"""WITH c AS (SELECT DISTINCT l_orderkey, p_brand, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS y FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O')),
k AS (SELECT p_brand AS coordinate, count(*) FILTER (y = 0) AS n_normal, count(*) FILTER (y = 1) AS n_patient FROM c GROUP BY ALL)
SELECT coordinate, n_normal, n_patient, round(n_normal / (n_normal + n_patient), 6) AS normal_prop, round(n_patient / (n_normal + n_patient), 6) AS patient_prop,
 (n_patient > n_normal)::INTEGER AS higher_in_patients FROM k""")
def coordinate_share_by_outcome(t):
    rows = calls(t).join(t.orders.filter(F.col("o_orderstatus").isin("F", "O")), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("l_orderkey", F.col("p_brand").alias("coordinate"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return genotype.share_by_outcome(rows, "l_orderkey", "coordinate", "y")


@query("G8 H1", f"""WITH f AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS flag FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY {uniform(20201012, 'id')}, id) AS r FROM f WHERE flag IS NOT NULL)
SELECT id, flag, l_linenumber, l_quantity FROM s LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber IN (1, 2, 3)) ON l_orderkey = id WHERE r <= 25""")
def recheck_sample(t):
    flags = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("flag"))
    raw = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_quantity")
    return genotype.recheck_sample(flags, raw, "id", "flag", "l_linenumber", [1, 2, 3])


@query("P9", f"""WITH {PRESENCE_SQL.format(item='p_brand')} SELECT id, c AS "Coordinate", present FROM pres WHERE c IN (SELECT c FROM pres GROUP BY c HAVING sum(present) > 1500)""")
def supported_features_long(t):
    return drop_rare_features(presence(t, "p_brand"), "Coordinate", 1500, "present").select("id", "Coordinate", "present")


@query("P9 A6", f"""WITH {PRESENCE_SQL.format(item='p_type')}, m AS (SELECT c, sum(present) AS s FROM pres GROUP BY c)
SELECT count(*) AS columns_kept, sum(s)::BIGINT AS total FROM m WHERE s > (SELECT median(s) FROM m)""")
def supported_columns_wide(t):
    from ..operators.ordered import quantiles
    from ..operators.summaries import column_sums
    wide = reshape.presence_matrix(presence(t), "id", "dementia", "Coordinate", TYPES)
    names = [f"coordinate_{x}" for x in TYPES]
    sums = column_sums(wide, names)
    middle = quantiles(sums, [], "total", {"m": .5}).first()["m"]
    kept = [c for c in drop_rare_columns(wide, names, middle).columns if c.startswith("coordinate_")]
    return sums.filter(F.col("feature").isin(kept)).agg(F.count(F.lit(1)).alias("columns_kept"), F.sum("total").alias("total"))


@query("A6", f"""WITH {PRESENCE_SQL.format(item='p_type')} SELECT 'coordinate_' || c AS feature, sum(present)::BIGINT AS total FROM pres GROUP BY c""")
def column_sums(t):
    from ..operators.summaries import column_sums as sums
    wide = reshape.presence_matrix(presence(t), "id", "dementia", "Coordinate", TYPES)
    return sums(wide, [f"coordinate_{x}" for x in TYPES])


@query("L4 S14", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)""")
def exclude_listed_people(t):
    listed = t.lineitem.filter(F.col("l_quantity") > 49).select(F.concat(F.lit("P_"), F.col("l_orderkey").cast("string")).alias("X1"))
    people = t.orders.select("o_orderkey", F.concat(F.lit("P-"), F.col("o_orderkey").cast("string")).alias("id"))
    return exclude_listed(people, listed, "id").select("o_orderkey")
