"""Queries: agreement, diagnostic accuracy, curves, rules and classifiers."""

from pyspark.sql import functions as F

from ..operators import accuracy, agreement, models
from ..operators.sampling import mark_split
from . import sqltext as Q
from .registry import query
from .variants import sets_sql
from .visits import KAPPA

BOTH = "pairs AS (SELECT 1 AS k, quality AS x, toxic AS y FROM labels)"


@query("T17", """SELECT count(*) AS n, round(avg((quality = toxic)::INTEGER) * 100, 6) AS percent_agreement FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def percent_agreement(t):
    return agreement.percent_agreement(t.labels, "quality", "toxic")


@query("T18 T17", f"""WITH {BOTH}, {KAPPA.format(by='k')} SELECT nn::BIGINT AS n, round(po * 100, 6) AS percent_agreement, round(kappa, 6) AS kappa, round(z, 6) AS z,
 round({Q.normal_two_sided_p('z')}, 6) AS p_value FROM kz""")
def kappa_two_raters(t):
    return agreement.kappa(t.labels, "quality", "toxic")


def rated(t):
    """Rated documents with a length-based prediction per source."""
    return t.labels.join(t.documents.select("doc_id", "source", "lang", "n_chars"), "doc_id").withColumn(
        "predicted", (F.col("n_chars") > 1000).cast("int"))


COUNTS = """
base AS (SELECT labels.*, lang, source, n_chars, (n_chars > 1000)::INTEGER AS predicted FROM labels JOIN documents USING (doc_id)),
k AS (SELECT lang, count(*) FILTER (predicted = 1 AND quality = 1)::DOUBLE AS tp, count(*) FILTER (predicted = 1 AND quality <> 1)::DOUBLE AS fp,
 count(*) FILTER (predicted <> 1 AND quality = 1)::DOUBLE AS fn, count(*) FILTER (predicted <> 1 AND quality <> 1)::DOUBLE AS tn FROM base
 WHERE predicted IS NOT NULL AND quality IS NOT NULL GROUP BY lang)"""
N = "(tp + fp + fn + tn)"


def counts(t):
    return accuracy.confusion_counts(rated(t), "predicted", "quality", ["lang"])


@query("T25", f"""WITH {COUNTS} SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / {N}, 6) AS accuracy,
 round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
 round(tn / nullif(tn + fp, 0), 6) AS true_negative_rate, round(tn / nullif(tn + fn, 0), 6) AS negative_predictive_value FROM k""")
def confusion_scores(t):
    return accuracy.scores(counts(t))


RATIO = """round(exp(ln({v}) {sign} 1.959963984540054 * sqrt({var})), 4)"""
LRP, LRN, OR = ("((tp / nullif(tp + fn, 0)) / nullif(fp / nullif(tn + fp, 0), 0))", "((fn / nullif(tp + fn, 0)) / nullif(tn / nullif(tn + fp, 0), 0))", "(tp * tn / nullif(fp * fn, 0))")
VP, VN, VO = ("1 / nullif(tp, 0) - 1 / nullif(tp + fn, 0) + 1 / nullif(fp, 0) - 1 / nullif(fp + tn, 0)", "1 / nullif(fn, 0) - 1 / nullif(tp + fn, 0) + 1 / nullif(tn, 0) - 1 / nullif(fp + tn, 0)", "1 / nullif(tp, 0) + 1 / nullif(fp, 0) + 1 / nullif(fn, 0) + 1 / nullif(tn, 0)")


@query("T20", f"""WITH {COUNTS} SELECT lang, round((tp + fp) / {N}, 6) AS apparent_prevalence, round((tp + fn) / {N}, 6) AS true_prevalence, round(tp / nullif(tp + fn, 0), 6) AS sensitivity,
 round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv,
 {', '.join(f"round({v}, 4) AS {n}, {RATIO.format(v=f'nullif({v}, 0)', var=var, sign='-')} AS {n}_low, {RATIO.format(v=f'nullif({v}, 0)', var=var, sign='+')} AS {n}_high" for n, v, var in [('lr_positive', LRP, VP), ('lr_negative', LRN, VN), ('odds_ratio', OR, VO)])} FROM k""",
       **{f"{n}{s}": 4 for n in ("lr_positive", "lr_negative", "odds_ratio") for s in ("", "_low", "_high")})
def diagnostic_accuracy(t):
    names = ["apparent_prevalence", "true_prevalence", "sensitivity", "specificity", "ppv", "npv"]
    ratios = [f"{n}{s}" for n in ("lr_positive", "lr_negative", "odds_ratio") for s in ("", "_low", "_high")]
    return accuracy.diagnostics(counts(t)).select("lang", *names, *ratios)


TAIL = """list_sum(list_transform(range({a}, {b} + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(mid) + (n - j) * ln(1 - mid))))"""
SHARES = {"apparent_prevalence": ("tp + fp", N), "true_prevalence": ("tp + fn", N), "sensitivity": ("tp", "tp + fn"), "specificity": ("tn", "tn + fp"),
          "ppv": ("tp", "tp + fp"), "npv": ("tn", "tn + fn"), "accuracy": ("tp + tn", N)}


def exact_intervals(*names):
    """Interval ends by bisection on the binomial sums: 46 halvings of 0 to 1."""
    rows = " UNION ALL ".join(f"SELECT lang, '{x}' AS name, ({SHARES[x][0]})::BIGINT AS i, ({SHARES[x][1]})::BIGINT AS n FROM k" for x in names)
    ends = ", ".join(f"round(max(v) FILTER (name = '{x}' AND side = '{s}'), 6) AS {x}_{s}" for x in names for s in ("low", "high"))
    return f"""WITH RECURSIVE {COUNTS}, q AS ({rows}),
bis AS (SELECT lang, name, i, n, side, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM (SELECT * FROM q WHERE n > 0), (SELECT unnest(['low', 'high']) AS side)
 UNION ALL SELECT lang, name, i, n, side, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, step + 1
 FROM (SELECT *, CASE side WHEN 'low' THEN {TAIL.format(a='i', b='n')} < 0.025 ELSE {TAIL.format(a='0', b='i')} > 0.025 END AS up FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE step < 46))),
e AS (SELECT lang, name, side, CASE WHEN side = 'low' AND i = 0 THEN 0 WHEN side = 'high' AND i = n THEN 1 ELSE (lo + hi) / 2 END AS v FROM bis WHERE step = 46)
SELECT lang, {ends} FROM e GROUP BY lang"""


@query("T21", exact_intervals("accuracy"))
def accuracy_interval(t):
    return accuracy.confusion_summary(counts(t)).select("lang", "accuracy_low", "accuracy_high")


@query("T20", exact_intervals("apparent_prevalence", "true_prevalence", "sensitivity", "specificity", "ppv", "npv"))
def diagnostic_intervals(t):
    """Exact binomial intervals."""
    names = ["apparent_prevalence", "true_prevalence", "sensitivity", "specificity", "ppv", "npv"]
    return accuracy.diagnostics(counts(t)).select("lang", *[f"{n}{s}" for n in names for s in ("_low", "_high")])


@query("T21", f"""WITH {COUNTS}, a AS (SELECT *, {N} AS n, (tp + tn) / {N} AS acc, greatest(tp + fn, fp + tn) / {N} AS nir, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / {N} ** 2 AS pe,
 greatest(abs(fp - fn) - 1, 0) ** 2 / nullif(fp + fn, 0) AS mc FROM k)
SELECT lang, round(acc, 6) AS accuracy, round(nir, 6) AS no_information_rate,
 round(list_sum(list_transform(range((tp + tn)::BIGINT, n::BIGINT + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1.0) - lgamma(n - j + 1) + j * ln(nir) + CASE WHEN nir < 1 THEN (n - j) * ln(1 - nir) WHEN j = n THEN 0 ELSE -1000 END))), 6) AS p_above_rate,
 round((acc - pe) / nullif(1 - pe, 0), 6) AS kappa, round(mc, 6) AS mcnemar, CASE WHEN mc IS NOT NULL THEN round({Q.chi2_p('greatest(mc, 1e-12)', '1')}, 4) END AS mcnemar_p, round(tp / n, 6) AS detection_rate,
 round((tp + fp) / n, 6) AS detection_prevalence, round((tp + fn) / n, 6) AS prevalence, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM a""", mcnemar_p=4)
def confusion_summary(t):
    return accuracy.confusion_summary(counts(t)).select(
        "lang", "accuracy", "no_information_rate", "p_above_rate", "kappa", "mcnemar", "mcnemar_p", "detection_rate", "detection_prevalence",
        "prevalence", "balanced_accuracy")


STEPS = """
base AS (SELECT quality, n_chars, lang FROM labels JOIN documents USING (doc_id)),
sc AS (SELECT lang, n_chars, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM base GROUP BY ALL),
st AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY lang) AS p, sum(neg) OVER (PARTITION BY lang) AS n FROM sc
 WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC))"""


@query("T22", f"""WITH {STEPS} SELECT lang, n_chars::DOUBLE AS n_chars, round(fp / nullif(n, 0), 6) AS fpr, round(tp / nullif(p, 0), 6) AS tpr FROM st
UNION ALL SELECT DISTINCT lang, NULL, 0, 0 FROM st""")
def roc_points(t):
    return accuracy.roc_points(rated(t), "n_chars", "quality", ["lang"]).withColumn("n_chars", F.col("n_chars").cast("double"))


@query("T24", f"""WITH {STEPS} SELECT lang, n_chars::DOUBLE AS n_chars, round(tp / (tp + fp), 6) AS precision, round(tp / nullif(p, 0), 6) AS recall FROM st
UNION ALL SELECT DISTINCT lang, NULL, 1, 0 FROM st""")
def pr_points(t):
    return accuracy.pr_points(rated(t), "n_chars", "quality", ["lang"]).withColumn("n_chars", F.col("n_chars").cast("double"))


@query("T23", f"""WITH {STEPS} SELECT lang, max(p)::BIGINT AS positives, max(n)::BIGINT AS negatives, round(sum(pos * (n - fp + neg / 2.0)) / nullif(max(p)::DOUBLE * max(n), 0), 6) AS auc FROM st GROUP BY lang""")
def auc(t):
    return accuracy.auc(rated(t), "n_chars", "quality", ["lang"])


ORDER_FLAGS = """f AS (SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS dementia, count(l_orderkey) AS n_variant, max((l_discount > 0.09)::INTEGER) AS e4_carrier, max((l_tax > 0.07)::INTEGER) AS g_hom
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query("M6 C29", f"""WITH {ORDER_FLAGS}, p AS (SELECT *, CASE WHEN e4_carrier = 1 OR g_hom = 1 THEN 1 WHEN e4_carrier = 0 AND g_hom = 0 THEN 0 END AS any_rule, (n_variant >= 3)::INTEGER AS count_rule FROM f)
SELECT dementia, any_rule::DOUBLE AS any_rule, count_rule, count(*) AS n FROM p GROUP BY ALL""")
def rule_classifier(t):
    rows = t.orders.join(t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_variant"), F.max((F.col("l_discount") > 0.09).cast("int")).alias("e4_carrier"),
        F.max((F.col("l_tax") > 0.07).cast("int")).alias("g_hom")), F.col("l_orderkey") == F.col("o_orderkey"), "left").na.fill(0, ["n_variant"])
    return rows.select((F.col("o_orderstatus") == "F").cast("int").alias("dementia"), models.rule_any("e4_carrier", "g_hom").cast("double").alias("any_rule"),
                       models.rule_at_least("n_variant").alias("count_rule")).groupBy("dementia", "any_rule", "count_rule").agg(F.count(F.lit(1)).alias("n"))


@query("H3", f"""SELECT o_orderstatus, ({Q.uniform(28, 'o_orderkey')} < 0.25)::INTEGER AS validation, count(*) AS n FROM orders GROUP BY ALL""")
def train_validation_split(t):
    return mark_split(t.orders, ["o_orderkey"]).groupBy("o_orderstatus", "validation").agg(F.count(F.lit(1)).alias("n"))


def document_features(t):
    """Rated documents with five 0/1 features and two counts scaled to small numbers."""
    has = lambda p: F.col("text").rlike(p).cast("int")
    return t.labels.join(t.documents, "doc_id").select(
        "doc_id", "quality", "toxic", has(r"\d").alias("digit"), has("http").alias("link"), has("@").alias("mail"), has(r"\n").alias("lines"),
        (F.col("lang") == "en").cast("int").alias("english"), F.floor(F.col("n_chars") / 1000).cast("int").alias("kilo"))


FEATURES = ["digit", "link", "mail", "lines", "english", "kilo"]
FEATURE_SQL = f"""x AS (SELECT doc_id, quality, toxic, regexp_matches(text, '[0-9]')::INTEGER AS digit, contains(text, 'http')::INTEGER AS link, contains(text, '@')::INTEGER AS mail,
 contains(text, chr(10))::INTEGER AS lines, (lang = 'en')::INTEGER AS english, (n_chars // 1000)::INTEGER AS kilo, {Q.uniform(28, 'doc_id')} < 0.25 AS val FROM labels JOIN documents USING (doc_id)),
d AS (SELECT v.doc_id, t.doc_id AS neighbour, t.quality AS neighbour_label, ({' + '.join(f'(v.{f} - t.{f}) ** 2' for f in FEATURES)})::DOUBLE AS distance FROM x v JOIN x t ON v.val AND NOT t.val),
nn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, neighbour) AS rank FROM d QUALIFY rank <= 5)"""


def neighbours(t):
    from ..operators.sampling import split
    rows = document_features(t).withColumn("x", F.array(*FEATURES))
    train, validation = split(rows, ["doc_id"])
    return models.nearest_neighbours(train, validation, "doc_id", "x", "quality")


def training(t):
    """Assembled training side of the split."""
    from ..operators.sampling import split
    return models.assemble(split(document_features(t), ["doc_id"])[0], FEATURES)


@query("M3", f"WITH {FEATURE_SQL} SELECT doc_id, rank, neighbour, distance, neighbour_label FROM nn")
def knn_neighbours(t):
    return neighbours(t).withColumn("rank", F.col("rank").cast("bigint"))


@query("M3", f"WITH {FEATURE_SQL} SELECT doc_id, round(avg(neighbour_label), 6) AS score, (avg(neighbour_label) > 0.5)::INTEGER AS prediction FROM nn GROUP BY doc_id")
def knn_vote(t):
    return models.knn_vote(neighbours(t), "doc_id")


@query("M1 M2 M3 M4 M5 T25")
def four_models_scores(t):
    """Scores of the four classifiers on one split; learners differ from other tools in detail."""
    predictions = models.compare_models(document_features(t), "doc_id", FEATURES, "quality")
    return accuracy.scores(accuracy.confusion_counts(predictions, "prediction", "quality", ["model"]))


@query("M5 T22 T23")
def four_models_auc(t):
    predictions = models.compare_models(document_features(t), "doc_id", FEATURES, "quality")
    return accuracy.auc(predictions, "score", "quality", ["model"])


@query("M1")
def logistic_coefficients(t):
    return models.coefficients(t.spark, models.logistic(training(t), "quality"), FEATURES)


@query("M1", f"SELECT unnest(['{"', '".join(FEATURES)}']) AS coordinate, 0.0::DOUBLE AS gradient", gradient=3)
def logistic_gradient(t):
    """The penalised gradient at the fitted coefficients, per training row: zero at the optimum."""
    rows = training(t)
    model = models.logistic(rows, "quality")
    n = rows.count()
    margin = F.lit(float(model.intercept))
    for f, b in zip(FEATURES, model.coefficients.toArray()):
        margin = margin + F.lit(float(b)) * F.col(f)
    residual = 1 / (1 + F.exp(-margin)) - F.col("quality")
    sums = rows.agg(*[((F.sum(residual * F.col(f)) + F.lit(float(b))) / n).alias(f) for f, b in zip(FEATURES, model.coefficients.toArray())])
    return sums.unpivot([], FEATURES, "coordinate", "gradient")


@query("M2 O2 V7")
def forest_top_importances(t):
    return models.top_importances(models.importances(t.spark, models.forest(training(t), "quality"), FEATURES))


@query("M1 M2 M3 M4 M5 O2 V7", f"""WITH {FEATURE_SQL}, v AS (SELECT english, count(*) AS n FROM x WHERE val GROUP BY english)
SELECT model, english, english AS prediction, n FROM v, (SELECT unnest(['Logistic_Regression', 'Random_Forest', 'Gradient_Boosting', 'K_Neighbors']) AS model)""")
def separable_predictions(t):
    """A label that one of three features states: every learner must get every validation row right."""
    rows = document_features(t).withColumn("told", F.col("english"))
    out = models.compare_models(rows, "doc_id", ["told", "digit", "lines"], "english")
    return out.groupBy("model", "english", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("M2 V7", "SELECT 'told' AS coordinate, 1.0::DOUBLE AS feature_importance")
def separable_importance(t):
    """Only the feature that states the label has any importance."""
    rows = models.assemble(document_features(t).withColumns({"told": F.col("english"), "flat": F.lit(0)}), ["told", "flat"])
    return models.top_importances(models.importances(t.spark, models.forest(rows, "english"), ["told", "flat"]), 1)


def combination_rows(t):
    from ..plans.genotype_flow import combination_vectors as vectors
    from .variants import calls
    rows = calls(t).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("dementia"),
        F.col("p_type").alias("Coordinate"), F.when(F.col("l_quantity") <= 10, "normal").otherwise("A>G").alias("Variant"))
    return vectors(rows, None, 5, haplotype=["PROMO", "SMALL"])


HAPLOTYPE_SETS = sets_sql("CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'haplotype' ELSE p_type END")


@query("G3 G4 G5 M5", f"""WITH {HAPLOTYPE_SETS}, s AS (SELECT k, item_set FROM combo GROUP BY ALL HAVING count(*) > 5), c AS (SELECT id, count(*) AS f FROM combo SEMI JOIN s USING (k, item_set) GROUP BY id),
p AS (SELECT DISTINCT id, dementia FROM pres) SELECT dementia, coalesce(f, 0)::INTEGER AS features, count(*) AS n FROM p LEFT JOIN c USING (id) GROUP BY ALL""")
def combination_vectors(t):
    """Classifier input from variant combinations: feature counts per subject group."""
    from pyspark.ml.functions import vector_to_array
    out, _ = combination_rows(t)
    size = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return out.groupBy("dementia", size.cast("int").alias("features")).agg(F.count(F.lit(1)).alias("n"))


@query("G3 G4 M1 M2 M3 M4 M5 T25")
def four_models_on_combinations(t):
    """From variant calls to the scores of the four classifiers, end to end."""
    rows, names = combination_rows(t)
    predictions = models.compare_on_vectors(rows, "id", "dementia", len(names))
    return accuracy.scores(accuracy.confusion_counts(predictions, "prediction", "dementia", ["model"]))
