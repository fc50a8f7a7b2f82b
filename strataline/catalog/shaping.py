"""Queries: columns, filters, long and wide forms, summaries, ordering, plot tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import all_known_mean, is_member
from ..operators import charts, columns, filters, normality, ordering, reshape, summaries
from . import sqltext as Q
from .registry import query


@query("P1 P2", "SELECT c_custkey, c_nationkey, c_acctbal, c_name FROM customer")
def chosen_columns(t):
    a = columns.choose(t.customer, 1, slice("c_nationkey", "c_acctbal"), "c_name")
    return columns.choose_where(a, columns.all_but(columns.one_of(["c_mktsegment"])))


@query("P2", "SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate::DATE::VARCHAR AS l_shipdate FROM lineitem")
def columns_by_pattern(t):
    out = columns.choose_where(t.lineitem, lambda c: columns.ends_with("key", "date")(c) and columns.starts_with("l_")(c))
    return out.withColumn("l_shipdate", F.to_date("l_shipdate").cast("string"))


@query("P3 P4 P5", "SELECT c_mktsegment AS segment, c_custkey AS custkey, c_name AS label, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer")
def renamed_columns(t):
    out = columns.rename_matching(columns.rename(t.customer, {2: "label", "c_mktsegment": "segment"}), (r"^c_", ""))
    return columns.move(columns.move(out, ["segment"]), ["acctbal"], after="nationkey")


@query("P6 L11", "SELECT s_suppkey::VARCHAR AS id, s_acctbal AS balance, NULL::DOUBLE AS age, s_name AS name FROM supplier")
def conformed_schema(t):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("balance", T.DoubleType()), T.StructField("age", T.DoubleType()), T.StructField("name", T.StringType())])
    return columns.conform(columns.rename(t.supplier, {"s_suppkey": "id", "s_acctbal": "balance", "s_name": "name"}), schema)


@query("P7 P8 P10 C26", """SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber, l_quantity, l_discount, round(l_quantity * l_discount, 6) AS interaction, TRY_CAST(l_returnflag AS DOUBLE) AS l_returnflag FROM lineitem""")
def cast_and_interact(t):
    wide = columns.drop(t.lineitem, [c for c in t.lineitem.columns if c not in ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")])
    return columns.product(columns.cast_all(wide, "double"), "l_quantity", "l_discount", "interaction")


@query("L1 L2 L3", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 30 OR l_discount < 0.02) AND l_returnflag IN ('A', 'R') AND (l_tax > 0.02)")
def filtered_lines(t):
    out = t.lineitem.withColumn("taxed", (F.col("l_tax") > 0.02).cast("int")).filter((F.col("l_quantity") > 30) | (F.col("l_discount") < 0.02))
    return filters.where_flag(filters.members(out, "l_returnflag", ["A", "R"]), "taxed").select("l_orderkey", "l_linenumber")


GAPS_SQL = "g AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS st, CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS price FROM orders)"


def gaps(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("st"), F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")).alias("price"))


@query("L3", f"WITH {GAPS_SQL} SELECT o_orderkey FROM g WHERE st IS NULL OR st <> 'F'")
def non_members(t):
    return filters.non_members(gaps(t), "st", ["F"]).select("o_orderkey")


@query("L5 L6 L7", f"""WITH {GAPS_SQL} SELECT count(*) FILTER (st IS NOT NULL) AS with_status, count(*) FILTER (st IS NOT NULL AND price IS NOT NULL) AS complete, count(*) FILTER (st IS NOT NULL OR price IS NOT NULL) AS not_empty FROM g""")
def missing_row_counts(t):
    g = gaps(t).drop("o_orderkey")
    n = lambda d: d.agg(F.count(F.lit(1))).scalar()
    one = g.agg(F.count("st").alias("with_status"))
    return one.select("with_status", n(filters.drop_missing(g)).alias("complete"), n(filters.drop_empty(g)).alias("not_empty"))


@query("L9", f"WITH {GAPS_SQL} SELECT o_orderkey, coalesce(st, 'none') AS st, coalesce(price, 0) AS price FROM g")
def filled_values(t):
    return filters.fill(gaps(t), {"st": "none", "price": 0})


@query("L8", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) ') OR regexp_matches(p_brand, '#1[0-9]$') OR p_partkey IN (3, 17)")
def regex_or_listed(t):
    rows = t.part.withColumn("id", F.col("p_partkey").cast("string"))
    return filters.match_any(rows, {"p_name": "^(red|blue) ", "p_brand": "#1[0-9]$"}, "id", ["3", "17"]).select("p_partkey", "p_name")


@query("L10 A11", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, CAST(ts AS DATE), event_type FROM events) GROUP BY 1")
def distinct_then_count(t):
    rows = t.events.withColumn("d", F.to_date("ts"))
    return summaries.distinct_counts(rows, ["user_id", "d", "event_type"], ["event_type"])


@query("R1 A5 A1", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS \"F\", count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS \"O\", count(*) FILTER (o_orderstatus = 'P')::DOUBLE AS \"P\" FROM orders GROUP BY ALL")
def frequency_table_wide(t):
    counts = summaries.count_by(t.orders, ["o_orderpriority", "o_orderstatus"]).withColumn("n", F.col("n").cast("double"))
    return reshape.to_wide(counts, ["o_orderpriority"], "o_orderstatus", "n", ["F", "O", "P"], fill=0.0)


@query("R2", "SELECT o_custkey, max((o_orderpriority = '1-URGENT')::INTEGER) AS \"is_1-URGENT\", max((o_orderpriority = '5-LOW')::INTEGER) AS \"is_5-LOW\" FROM orders GROUP BY ALL")
def indicator_columns(t):
    return reshape.to_indicators(t.orders, ["o_custkey"], "o_orderpriority", ["1-URGENT", "5-LOW"], "is_")


@query("R3", "SELECT p_partkey, variable, value FROM (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part) UNPIVOT (value FOR variable IN (p_size, p_retailprice))")
def wide_to_long(t):
    return reshape.to_long(t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("R4 P4 L7 U1", """SELECT c_mktsegment AS sex, c_name AS "PHQ_1", 1 AS ordinal FROM customer UNION ALL SELECT CASE WHEN c_acctbal > 0 THEN c_mktsegment END, CASE WHEN c_acctbal > 0 THEN CAST(c_custkey AS VARCHAR) END, 2 FROM customer WHERE c_acctbal > 0""")
def stacked_waves(t):
    some = lambda c: F.when(F.col("c_acctbal") > 0, c)
    wide = t.customer.select(F.col("c_mktsegment").alias("sex"), F.col("c_name").alias("PHQ1_1"), some(F.col("c_mktsegment")).alias("sex2"), some(F.col("c_custkey").cast("string")).alias("PHQ2_1"))
    rule = [(r"^([A-Za-z]+)\d$", r"\1"), (r"^([A-Za-z]+)\d(_\d+)$", r"\1\2")]
    return reshape.stack_blocks(wide, ["sex", "sex2"], [rule, rule])


@query("U1", "SELECT c_custkey AS key, c_mktsegment, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def union_by_name(t):
    return reshape.stack(t.customer.select(F.col("c_custkey").alias("key"), "c_mktsegment"), t.supplier.select(F.col("s_suppkey").alias("key"), "s_name"))


@query("A2", """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS c_acctbal_mean, round(stddev_samp(c_acctbal), 4) AS c_acctbal_sd, round(stddev_samp(c_acctbal) / sqrt(count(*)), 4) AS c_acctbal_se FROM customer GROUP BY ALL""", digits=4)
def mean_sd_se(t):
    return summaries.describe(t.customer, ["c_mktsegment"], ["c_acctbal"])


@query("A2", f"""WITH {GAPS_SQL}, x AS (SELECT o_orderkey % 500 AS k, price FROM g) SELECT k, count(*) AS n, round(CASE WHEN count(*) = count(price) THEN avg(price) END, 3) AS mean FROM x GROUP BY ALL""", mean=3)
def mean_with_missing(t):
    return gaps(t).groupBy(F.pmod("o_orderkey", F.lit(500)).alias("k")).agg(F.count(F.lit(1)).alias("n"), all_known_mean("price").alias("mean"))


@query("A3", "SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'N') AS n FROM lineitem GROUP BY ALL")
def predicate_counts(t):
    return summaries.count_where(t.lineitem, ["l_suppkey"], F.col("l_returnflag") != "N")


@query("A4", "SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS proportion FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def shares_within(t):
    return summaries.shares(t.orders, ["o_orderstatus", "o_orderpriority"], ["o_orderstatus"])


@query("A5 A4", "SELECT quality::VARCHAR AS row_level, toxic::VARCHAR AS col_level, n, round(n / sum(n) OVER (), 4) AS proportion FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL)")
def contingency_shares(t):
    return summaries.proportions(summaries.contingency(t.labels, "quality", "toxic"), digits=4)


@query("A8", """SELECT min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
 max(o_totalprice) AS max, count(*) FILTER (o_totalprice IS NULL) AS n_missing FROM orders""", digits=4)
def six_number_summary(t):
    return summaries.six_numbers(t.orders, "o_totalprice")


@query("A8", f"""WITH {GAPS_SQL} SELECT st, min(price) AS min, round(quantile_cont(price, 0.25), 4) AS q1, round(quantile_cont(price, 0.5), 4) AS median, round(avg(price), 4) AS mean, round(quantile_cont(price, 0.75), 4) AS q3, max(price) AS max,
 count(*) FILTER (price IS NULL) AS n_missing FROM g GROUP BY st""", digits=4)
def six_numbers_by_group(t):
    return summaries.six_numbers(gaps(t), "price", ["st"])


@query("A9", "SELECT event_type, min(value) AS min, max(value) AS max FROM events GROUP BY ALL")
def value_ranges(t):
    return summaries.value_range(t.events, "value", ["event_type"])


@query("A10 A1", f"""WITH {GAPS_SQL} SELECT 'All' AS st, count(*) AS n, round(avg(price), 4) AS mean FROM g UNION ALL SELECT st, count(*), round(avg(price), 4) FROM g GROUP BY st""", mean=4)
def strata_grouping_sets(t):
    return summaries.with_overall(gaps(t), "st", "All", [], F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"))


@query("O1 O2", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10")
def top_rows(t):
    return ordering.top(t.customer.select("c_custkey", "c_acctbal"), ["-c_acctbal", "c_custkey"])


@query("O1", f"WITH {GAPS_SQL} SELECT o_orderkey, st, price FROM g")
def sorted_rows(t):
    return ordering.sort(gaps(t), "st", "-price", "o_orderkey")


@query("O3 V4", """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_type, n, round(n / sum(n) OVER (PARTITION BY p_brand), 6) AS proportion, (sum(n) OVER (PARTITION BY p_brand))::BIGINT AS category_total FROM c""")
def stacked_share(t):
    return charts.stacked_shares(t.part, "p_brand", "p_type")


@query("O4", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def coordinate_order(t):
    return ordering.in_coordinate_order(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_linenumber")


@query("O5", """SELECT doc_id, (row_number() OVER (PARTITION BY lang, source, n_chars // 500 ORDER BY n_chars DESC, doc_id) > 1)::INTEGER AS duplicate FROM documents""")
def flag_duplicates(t):
    rows = t.documents.select("doc_id", "lang", "source", "n_chars", F.floor(F.col("n_chars") / 500).alias("size"))
    return ordering.flag_duplicates(rows, ["lang", "source", "size"], "n_chars", "doc_id").select("doc_id", "duplicate")


@query("O5", """WITH d AS (SELECT lang, (row_number() OVER (PARTITION BY lang, text ORDER BY n_chars DESC, doc_id) > 1)::INTEGER AS duplicate FROM documents)
SELECT lang, count(*) AS records, sum(duplicate)::BIGINT AS duplicates, round(avg(duplicate), 6) AS duplicate_share FROM d GROUP BY lang""")
def duplicate_metrics(t):
    """Exact copies of whole texts; the position key is a 256-bit digest of the text."""
    rows = t.documents.select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("digest"))
    return ordering.duplicate_metrics(ordering.flag_duplicates(rows, ["lang", "digest"], "n_chars", "doc_id"), ["lang"])


@query("V1", """WITH q AS (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY ALL),
j AS (SELECT *, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM orders JOIN q USING (o_orderpriority))
SELECT o_orderpriority, any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, min(o_totalprice) FILTER (ok) AS whisker_low, max(o_totalprice) FILTER (ok) AS whisker_high,
 count(*) FILTER (NOT ok) AS n_outliers FROM j GROUP BY ALL""", digits=4)
def box_numbers(t):
    return charts.box_numbers(t.orders, "o_totalprice", ["o_orderpriority"])


@query("V1", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY ALL)
SELECT event_type, value, count(*) AS n FROM events JOIN q USING (event_type) WHERE NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) GROUP BY ALL""")
def box_outliers(t):
    return charts.box_outliers(t.events, "value", ["event_type"])


@query("V2", "SELECT l_returnflag, floor(l_quantity / 5) * 5 AS bin_start, count(*) AS n FROM lineitem GROUP BY ALL")
def hist_bins(t):
    return charts.histogram(t.lineitem, "l_quantity", 5, ["l_returnflag"])


@query("V2", """WITH r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT least(floor((o_totalprice - a) / ((b - a) / 30)), 29)::INTEGER AS bin, count(*) AS n FROM orders, r GROUP BY ALL""")
def hist_equal_bins(t):
    return charts.histogram_equal(t.orders, "o_totalprice")


@query("V3", f"""WITH r AS (SELECT c_mktsegment, c_custkey, c_acctbal AS sample, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n,
 quantile_cont(c_acctbal, 0.25) OVER (PARTITION BY c_mktsegment) AS q1, quantile_cont(c_acctbal, 0.75) OVER (PARTITION BY c_mktsegment) AS q3 FROM customer),
s AS (SELECT *, (q3 - q1) / (2 * {Q.normal_quantile('0.75::DOUBLE')}) AS slope FROM r)
SELECT c_mktsegment, c_custkey, i, round({Q.normal_quantile('((i - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END)::DOUBLE / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END))::DOUBLE')}, 6) AS theoretical, sample,
 round(slope, 4) AS line_slope, round(q1 + slope * {Q.normal_quantile('0.75::DOUBLE')}, 4) AS line_intercept FROM s""", line_slope=4, line_intercept=4)
def qq_points(t):
    return normality.qq_points(t.customer, "c_acctbal", ["c_mktsegment"], ["c_custkey"])


@query("L3 A1", f"WITH {GAPS_SQL} SELECT coalesce(st IN ('F'), false)::INTEGER AS is_f, count(*) AS n FROM g GROUP BY ALL")
def membership_flag(t):
    return gaps(t).groupBy(is_member("st", ["F"]).cast("int").alias("is_f")).agg(F.count(F.lit(1)).alias("n"))
