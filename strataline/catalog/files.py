"""Queries: file sources and sinks. Each writes derived rows to the shared folder and reads them back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import accuracy, means
from ..plans import cohort
from ..session import shared_dir
from ..sources import manifest, readers, writers
from .registry import query
from .shaping import GAPS_SQL, gaps


@query("S1 S7", "WITH o AS (SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS st, o_orderpriority AS p FROM orders) SELECT * FROM o")
def text_csv_round_trip(t):
    path = shared_dir(t.spark, "text-csv")
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("st"), F.col("o_orderpriority").alias("p"))
    writers.write_csv(rows, path, missing="NA")
    return readers.read_text_csv(t.spark, path, ["o_orderkey", "st", "p"])


@query("S1 S7 C15", """SELECT user_id::VARCHAR AS user_id, count(DISTINCT CAST(ts AS DATE)) AS lines FROM events GROUP BY user_id""")
def packed_csv_round_trip(t):
    """Cells with line breaks survive, and the byte-order mark is not part of the first name."""
    path = shared_dir(t.spark, "packed-csv")
    cells = t.events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set(F.date_format("ts", "yyyy-MM-dd"))), "\n").alias("days"))
    writers.write_csv(cells, path, bom=True)
    back = readers.read_text_csv(t.spark, path, packed=True)
    from ..functions.text import pieces
    return back.select("user_id", pieces("days").cast("bigint").alias("lines"))


@query("S2", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def typed_csv_round_trip(t):
    path = shared_dir(t.spark, "typed-csv")
    writers.write_csv(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderpriority", T.StringType())])
    return readers.read_typed_csv(t.spark, path, schema).filter(F.col("_corrupt").isNull()).drop("_corrupt")


@query("S3", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_nationkey::VARCHAR AS code FROM customer")
def positional_read(t):
    path = shared_dir(t.spark, "positional")
    writers.write_csv(t.customer.select("c_custkey", "c_name", "c_nationkey"), path)
    return readers.read_positional(t.spark, path, ["id", "name", "code"])


@query("S4", "SELECT event_type AS id, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def subject_files_scan(t):
    path = shared_dir(t.spark, "per-subject")
    t.events.select("event_type", "event_id", "user_id").write.partitionBy("event_type").option("header", True).csv(path)
    rows = readers.read_subject_files(t.spark, path, ["event_id", "user_id"], r"event_type=(\w+)", group=1, whole_path=True)
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("S4", "SELECT DISTINCT event_type AS id FROM events")
def subjects_with_files(t):
    path = shared_dir(t.spark, "per-subject")
    t.events.select("event_type", "event_id").write.partitionBy("event_type").parquet(path)
    return readers.list_subjects(t.spark, path, r"event_type=(\w+)", group=1, whole_path=True).filter("id IS NOT NULL")


@query("S5", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def chosen_ids_by_list(t):
    path = shared_dir(t.spark, "by-id")
    writers.write_table(t.events.select("event_id", "event_type"), path, ["event_type"])
    return readers.read_chosen(t.spark, path, "event_type", ["click", "view"])


@query("S5", """SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING max(value) > 350)""")
def chosen_ids_by_table(t):
    path = shared_dir(t.spark, "by-id")
    writers.write_table(t.events.select("event_id", "event_type"), path, ["event_type"])
    chosen = t.events.groupBy("event_type").agg(F.max("value").alias("m")).filter("m > 350").select("event_type")
    return readers.read_chosen(t.spark, path, "event_type", chosen)


@query("S6", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part")
def tab_separated_read(t):
    path = shared_dir(t.spark, "tsv")
    t.part.select("p_partkey", "p_name", "p_brand").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_tsv(t.spark, path, ["p_partkey", "p_name", "p_brand"])


@query("S7", f"WITH {GAPS_SQL} SELECT coalesce(st, 'NULL') AS st, count(*) AS n FROM g GROUP BY ALL")
def csv_null_text(t):
    path = shared_dir(t.spark, "null-text")
    writers.write_csv(gaps(t).select("o_orderkey", "st"), path, missing="NULL")
    back = readers.read_text_csv(t.spark, path, ["o_orderkey", "st"])
    return back.groupBy("st").agg(F.count(F.lit(1)).alias("n"))


@query("S8", """WITH m AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS n_x, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS n_y,
 avg(o_totalprice) FILTER (o_orderstatus = 'F') AS mean_x, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS mean_y FROM orders GROUP BY ALL)
SELECT 'price' AS family, 'o_orderpriority=' || o_orderpriority AS test_key, measure, round(value, 3) AS value FROM m UNPIVOT (value FOR measure IN (n_x, n_y, mean_x, mean_y))""", value=3)
def tidy_report(t):
    path = shared_dir(t.spark, "report")
    tests = means.t_test(t.orders, "o_totalprice", "o_orderstatus", "F", "O", ["o_orderpriority"])
    writers.write_results(writers.tidy_results(tests, "price", ["o_orderpriority"], ["n_x", "n_y", "mean_x", "mean_y"]), path)
    return readers.read_table(t.spark, path).select("family", "test_key", "measure", "value")


@query("S9", """SELECT lang, count(*) FILTER (n_chars > 1000 AND quality = 1) AS tp, round(avg(((n_chars > 1000)::INTEGER = quality)::INTEGER), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def scores_round_trip(t):
    from .raters import counts
    path = shared_dir(t.spark, "scores")
    writers.write_csv(accuracy.scores(counts(t)).select("lang", "tp", "accuracy"), path)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("tp", T.LongType()), T.StructField("accuracy", T.DoubleType())])
    return readers.read_typed_csv(t.spark, path, schema).drop("_corrupt")


@query("S10 C20", """SELECT '2021-03-05' AS run_date, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT '2021-03-06', count(*) FROM orders""")
def run_dated_output(t):
    """A rerun of one date replaces that date only."""
    path = shared_dir(t.spark, "dated")
    o = t.orders.select("o_orderkey", "o_orderstatus")
    writers.write_dated(o, path, "2021-03-05")
    writers.write_dated(o, path, "2021-03-06")
    writers.write_dated(o.filter("o_orderstatus = 'F'"), path, "2021-03-05")
    return readers.read_table(t.spark, path).groupBy(F.col("run_date").cast("string").alias("run_date")).agg(F.count(F.lit(1)).alias("n"))


@query("S11", """SELECT CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END || '/' || o_orderstatus AS cohort, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL""")
def cohort_folders(t):
    path = shared_dir(t.spark, "cohorts")
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    part = lambda high, s: o.filter((F.col("o_totalprice") > 200000) == high).filter(F.col("o_orderstatus") == s)
    writers.write_cohorts({f"{n}/{s}": part(h, s) for n, h in (("high", True), ("low", False)) for s in ("F", "O")}, path)
    return readers.read_table(t.spark, path).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


FILES_SQL = """f AS (SELECT '/reads/' || (20200000 + o_custkey % 9000) || '/fastq/' || o_orderstatus || '/' || CASE WHEN o_orderkey % 2 = 0 THEN 'N-' ELSE 'P' END || (10 + o_orderkey) || '_R1_001.gz' AS r1, o_orderkey, o_custkey, o_orderstatus FROM orders)"""


@query("S13 C7", f"""WITH {FILES_SQL} SELECT r1, CASE WHEN o_orderkey % 2 = 0 THEN 'N-' ELSE 'P' END || (10 + o_orderkey) AS sample, CAST(20200000 + o_custkey % 9000 AS VARCHAR) AS library, o_orderstatus AS lane,
 '@RG\\tID:G1\\tLB:' || (20200000 + o_custkey % 9000) || '-' || o_orderstatus || '\\tPL:ILLUMINA\\tSM:' || CASE WHEN o_orderkey % 2 = 0 THEN 'N-' ELSE 'P' END || (10 + o_orderkey) AS read_group,
 CASE WHEN o_orderstatus <> 'P' THEN replace(r1, 'R1', 'R2') END AS r2 FROM f""")
def read_manifest(t):
    """Read-file pairs; mates of one lane are missing."""
    name = F.concat(F.lit("/reads/"), (20200000 + F.col("o_custkey") % 9000).cast("string"), F.lit("/fastq/"), F.col("o_orderstatus"), F.lit("/"),
                    F.when(F.col("o_orderkey") % 2 == 0, "N-").otherwise("P"), (10 + F.col("o_orderkey")).cast("string"))
    first = t.orders.select(F.concat(name, F.lit("_R1_001.gz")).alias("path"))
    second = t.orders.filter("o_orderstatus <> 'P'").select(F.concat(name, F.lit("_R2_001.gz")).alias("path"))
    return manifest.read_manifest(first.unionByName(second), "G1")


@query("S12 R6", "SELECT c_custkey AS person_id, CASE WHEN c_nationkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender, c_mktsegment AS birth_date FROM customer")
def fact_table_round_trip(t):
    from ..plans.facts import person_facts
    path = shared_dir(t.spark, "person")
    wide = t.customer.withColumn("sex", F.when(F.pmod("c_nationkey", F.lit(2)) == 0, "M").otherwise("F"))
    writers.write_table(person_facts(wide, "c_custkey", "sex", "c_mktsegment"), path)
    return readers.read_table(t.spark, path)


MASTER_SQL = """
a AS (SELECT 'P-' || c_custkey AS master_no, c_custkey::VARCHAR AS key_id, c_mktsegment AS gender, '2020-01-01' AS visit FROM customer WHERE c_nationkey < 18),
b AS (SELECT 'C-' || c_custkey AS registry_no, c_custkey::VARCHAR AS key_id, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS gender, '2021-01-01' AS visit FROM customer WHERE c_nationkey >= 6),
v AS (SELECT o_custkey::VARCHAR AS key_id, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 'A>G' END) AS v1, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS p1, max(CASE WHEN o_orderpriority = '2-HIGH' THEN 'A>G' END) AS v2,
 max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END) AS p2 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL),
ab AS (SELECT key_id, master_no, registry_no, coalesce(a.gender, b.gender) AS gender, CASE WHEN a.visit IS NULL THEN b.visit WHEN b.visit IS NULL THEN a.visit ELSE a.visit || chr(10) || b.visit END AS visit FROM a FULL JOIN b USING (key_id))"""


@query("J3 J1 P5 R1 C29", f"""WITH {MASTER_SQL} SELECT key_id, master_no, registry_no, gender, visit, v1 AS urgent_variant, v2 AS high_variant, CASE WHEN p1 + p2 = 2 THEN 1 END::DOUBLE AS both_present FROM ab FULL JOIN v USING (key_id)""")
def master_table(t):
    """Two registries and a variant table merged by person key."""
    c = t.customer
    key = F.col("c_custkey").cast("string").alias("key_id")
    a = c.filter("c_nationkey < 18").select(F.concat(F.lit("P-"), F.col("c_custkey").cast("string")).alias("master_no"), key, F.col("c_mktsegment").alias("gender"), F.lit("2020-01-01").alias("visit"))
    b = c.filter("c_nationkey >= 6").select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("registry_no"), key,
                                            F.when(F.pmod("c_nationkey", F.lit(2)) == 0, F.col("c_mktsegment")).alias("gender"), F.lit("2021-01-01").alias("visit"))
    levels = ["1-URGENT", "2-HIGH"]
    calls = t.orders.select(F.col("o_custkey").cast("string").alias("key_id"), F.col("o_orderpriority").alias("Coordinate"), F.lit("A>G").alias("Variant"))
    v = cohort.variant_columns(calls, "key_id", levels, "x")
    v = v.select("key_id", F.col("x_coordinate_1-URGENT_variant").alias("urgent_variant"), F.col("x_coordinate_2-HIGH_variant").alias("high_variant"),
                 (F.col("x_coordinate_1-URGENT") + F.col("x_coordinate_2-HIGH") == 2).cast("int").cast("double").alias("both_present"))
    return cohort.master_table(a, [b, v], front=["key_id", "master_no", "registry_no"])
