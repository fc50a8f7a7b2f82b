"""Operators against brute force on small frames, with the split paths forced."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.operators import accuracy, charts, columns, genotype, joins, linkage, matching, means, models, normality, ordering, regression, reshape, sampling, tables
from strataline.plans.genotype_flow import combination_vectors
from strataline.sources import manifest


def visits(n=300, seed=5):
    rng = random.Random(seed)
    return [("hot" if rng.random() < .4 else rng.choice("abc"), rng.choice("xyz"), float(rng.randint(0, 30)), rng.randint(0, 1), i) for i in range(n)]


SCHEMA = "k string, g string, v double, y int, id int"


@pytest.mark.parametrize("f", [
    lambda d: means.levene_test(d, "v", "g", ["k"]),
    lambda d: means.t_test_by_spread(d, "v", "y", 0, 1, ["k"]),
    lambda d: charts.box_numbers(d, "v", ["k"]),
    lambda d: accuracy.auc(d, "v", "y", ["k"]),
    lambda d: accuracy.roc_points(d, "v", "y", ["k"]),
    lambda d: ordering.flag_duplicates(d, ["k", "g"], "v", "id"),
    lambda d: normality.qq_points(d, "v", ["k"], ["id"]),
    lambda d: tables.chi_squared(d, "g", "y", ["k"]),
    lambda d: matching.exact_match(d, "y", ["k", "v"]),
    lambda d: joins.with_at_least(d, ["k", "g", "v"], 3),
    lambda d: joins.link_registries(d.select("id", "k"), [(d.select("id", "g"), ["id"])], ["id"]),
])
def test_split_paths_change_nothing(spark, f):
    df = spark.createDataFrame(visits(), SCHEMA)
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    plain = sorted(map(key, f(df).collect()), key=str)
    spark.conf.set("strataline.group_rows", "9")
    try:
        split = sorted(map(key, f(df).collect()), key=str)
    finally:
        spark.conf.unset("strataline.group_rows")
    assert split == plain and plain


def test_levene_and_anova_need_no_weights_to_agree(spark):
    """A frequency table gives the same tests as its rows."""
    df = spark.createDataFrame(visits(), SCHEMA)
    freq = df.groupBy("k", "g", "v").count()
    for f in (means.levene_test, means.anova, means.bartlett_test):
        a = {r["k"]: r for r in rows(f(df, "v", "g", ["k"]))}
        b = {r["k"]: r for r in rows(f(freq, "v", "g", ["k"], weight="count"))}
        assert all(a[k]["statistic"] == pytest.approx(b[k]["statistic"], rel=1e-10) for k in a) and len(a) == 4


def test_anova_of_two_groups_is_squared_t(spark):
    df = spark.createDataFrame(visits(), SCHEMA)
    t = {r["k"]: r for r in rows(means.t_test(df, "v", "y", 0, 1, ["k"], var_equal=True))}
    f = {r["k"]: r for r in rows(means.anova(df, "v", "y", ["k"]))}
    for k in t:
        assert f[k]["statistic"] == pytest.approx(t[k]["statistic"] ** 2, rel=1e-9)
        assert f[k]["p_value"] == pytest.approx(t[k]["p_value"], rel=1e-9)


def test_coalesce_join(spark):
    x = spark.createDataFrame([(1, "a\nb", "p", 1), (2, None, "q", 2), (3, "s", None, 3)], "k int, note string, only_x string, num int")
    y = spark.createDataFrame([(1, "b\nc", 1.5, 7), (2, "z", 2.5, 2), (4, "w", 3.5, None)], "k int, note string, only_y double, num int")
    out = joins.coalesce_join(x, y, ["k"])
    assert out.columns == ["k", "note", "only_x", "num", "only_y"]
    got = {r["k"]: tuple(r)[1:] for r in out.collect()}
    assert got == {1: ("a\nb\nc", "p", "1\n7", 1.5), 2: ("z", "q", "2", 2.5), 3: ("s", None, "3", None), 4: ("w", None, None, 3.5)}


def test_coalesce_join_with_itself_changes_nothing(spark):
    x = spark.createDataFrame([(1, "a\nb"), (2, None)], "k int, note string")
    assert sorted(map(tuple, joins.coalesce_join(x, x, ["k"]).collect())) == [(1, "a\nb"), (2, None)]


def test_grid_and_annotation(spark):
    calls = spark.createDataFrame([("N_1", "TOP", 10, "A>G", "hom", "yes", "mis"), ("P_2", "TOP", 11, "C>T", "het", "yes", "syn"), ("P_2", "OTHER", 5, "C>T", "het", "yes", "syn")],
                                  "id string, Gene string, Coordinate int, Variant string, Genotype string, Exonic string, Consequence string")
    subjects = spark.createDataFrame([("N_1",), ("P_2",), ("P_3",)], "id string")
    out = {(r["id"], r["Coordinate"]): r for r in rows(genotype.variant_table(calls, subjects, ["mis", "syn"], "TOP"))}
    assert len(out) == 6
    assert out["N-1", 10]["Genotype"] == "homozygous mutant type" and out["N-1", 10]["mis"] == 1 and out["N-1", 10]["dementia"] == 0
    assert out["P-3", 10]["Variant"] == "normal" and out["P-3", 10]["Genotype"] == "homozygous wild type" and out["P-3", 10]["Exonic"] == "no"
    assert out["P-3", 10]["mis"] == 0 and out["P-3", 10]["dementia"] == 1
    form2 = spark.createDataFrame([("N1", "G", 7, "A", "exonic", "T", ".", "het"), ("P2", "G", 8, "C", "exonic", "G", "syn", "hom")],
                                  "master_no string, gene string, coordinate int, Ref string, func string, Alt string, exonic_func string, genotype string")
    out = {(r["master_no"], r["coordinate"]): r for r in rows(genotype.annotated_table(form2, form2))}
    assert out["N1", 7]["exonic_func"] == "intronic SNV" and out["N1", 8]["exonic_func"] == "normal"
    assert out["N1", 8]["Alt"] == "C" and out["P2", 8]["Alt"] == "G" and out["N1", 8]["genotype"] == "homozygous wild type"


def test_burden_zeros_without_a_grid(spark):
    subjects = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "s string, y int")
    calls = spark.createDataFrame([("a", "G"), ("a", "G"), ("c", "H")], "s string, gene string")
    got = {(r["gene"], r["y"], r["burden"]): r["n"] for r in rows(genotype.burden_frequencies(calls, subjects, "s", "gene", "y", [0, 1]))}
    assert got == {("G", 0, 2): 1, ("G", 0, 0): 1, ("G", 1, 0): 2, ("H", 1, 1): 1, ("H", 1, 0): 1, ("H", 0, 0): 2}


def brute_combinations(sets):
    out = Counter()
    for s in sets:
        items = sorted(s)
        for c in itertools.combinations(items, 3):
            out[3, "_".join(c)] += 1
        if len(items) in (1, 2):
            out[len(items), "_".join(items)] += 1
    return out


@pytest.mark.parametrize("threshold", [0, 2])
def test_combinations_like_brute_force(spark, threshold):
    rng = random.Random(2)
    sets = [set(rng.sample("abcdefg", rng.randint(0, 6))) for _ in range(40)] + [set("ab")] * 5
    presence = spark.createDataFrame([(i, c, int(c in s)) for i, s in enumerate(sets) for c in "abcdefg"], "id int, c string, present int")
    expected = {k: n for k, n in brute_combinations(sets).items() if n > threshold}
    support = {(r["k"], r["item_set"]): r["support"] for r in rows(genotype.combination_support(presence, "id", "c", threshold))}
    assert support == expected
    per_subject = Counter((r["k"], r["item_set"]) for r in rows(genotype.subject_combinations(presence, "id", "c", threshold)))
    assert per_subject == expected


def test_triples_are_formed_of_supported_pairs_only(spark):
    # a_ and b meet often, c with either of them never more than twice together
    sets = [["a_", "b", "x"]] * 3 + [["a_", "b", "c"]] * 2 + [["b", "c", "y"]] * 2 + [["a_", "c"]] * 9 + [["c", "x", "y"], ["a_", "b", "c", "x", "y"]]
    patterns = spark.createDataFrame([(len(s), s, 1) for s in sets], "size bigint, items array<string>, n bigint")
    pairs = genotype.supported_pairs(patterns, 3)
    count = Counter(p for s in sets if len(s) > 2 for p in itertools.combinations([x.replace("_", "\\_") for x in s], 2))
    assert {(r["item"], o) for r in rows(pairs) for o in r["later"]} == {p for p, n in count.items() if n > 3}
    formed = [(r["a"], r["b"], r["c"]) for r in rows(genotype.candidate_triples(patterns, pairs))]
    wanted = [t for s in sets for t in itertools.combinations([x.replace("_", "\\_") for x in s], 3) if all(count[p] > 3 for p in itertools.combinations(t, 2))]
    assert sorted(formed) == sorted(wanted)
    assert 0 < len(formed) < sum(1 for s in sets for _ in itertools.combinations(s, 3))
    assert genotype.candidate_triples(patterns.limit(0), pairs).count() == 0


def test_presence_counts_levels_that_nobody_listed(spark):
    calls = [(i, i % 2, f"T{k}", int((i + k) % 3 > 0)) for i in range(9) for k in range(7)] + [(9, 1, None, 1), (10, 0, "T0", 0)]
    presence = spark.createDataFrame(calls, "id int, y int, c string, present int")
    burden = Counter()
    for i, _, _, p in calls:
        burden[i] += p
    wide = {r["id"]: r for r in rows(reshape.presence_matrix(presence, "id", "y", "c", [f"T{k}" for k in range(6)]))}
    assert {i: r["n_variant"] for i, r in wide.items()} == burden and "coordinate_T6" not in wide[0]
    levels = reshape.presence_levels(presence, "c")
    assert sorted((r["level"], r["c"]) for r in rows(levels)) == [(k + 1, f"T{k}") for k in range(7)]
    sparse = {r["id"]: r["levels"] for r in rows(reshape.presence_sparse(presence, "id", "y", "c", levels))}
    assert sparse == {**{i: [k + 1 for k in range(7) if (i + k) % 3 > 0] for i in range(9)}, 9: [], 10: []}


def test_blocks_out_of_reach_stay_closed(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random((60, 2)) + 10 * g for g in range(5)])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], [f"i{j}" for j in range(i % 50)], 0) for i in range(300)], "id int, f array<double>, s array<string>, y int")
    train, asked = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    for feature, sets in (("f", False), ("s", True)):
        work = rows(models.opened_blocks(train, asked, "id", feature, "y", 4, 20, sets))[0]
        assert work["pairs"] > 15 and work["opened"] < 0.6 * work["pairs"]
        got = {}
        for r in rows(models.nearest_neighbours(train, asked, "id", feature, "y", 4, 20, sets)):
            got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
        for i in range(0, 300, 3):
            d = sorted(((float(((x[i] - x[j]) ** 2).sum()) if not sets else abs(i % 50 - j % 50)), j) for j in range(300) if j % 3)[:4]
            assert [n for _, n in sorted(got[i])] == [j for _, j in d]


def test_people_behind_several_keys(spark, small_groups):
    rng = random.Random(3)
    data = [(str(i), rng.choice([None, *range(40)]), rng.choice([None, *range(40)]), "all" if 80 <= i < 100 else None) for i in range(1, 100)]
    got = {r["key_id"]: r["person_id"] for r in rows(linkage.with_person(spark.createDataFrame(data, "key_id string, a int, b int, c string"), "key_id", ["a", "b", "c"]))}
    root = {k: int(k) for k, *_ in data}
    changed = True
    while changed:
        changed = False
        for k, *x in data:
            for j, *y in data:
                if any(p is not None and p == q for p, q in zip(x, y)) and root[j] < root[k]:
                    root[k], changed = root[j], True
    assert got == root
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "u bigint, v bigint")
    assert {(r["node"], r["root"]) for r in rows(linkage.stars(chain))} == {(i, 0) for i in range(1, 13)}
    assert linkage.stars(chain.limit(0)).count() == 0


def test_combination_vectors_and_haplotype(spark):
    rows_ = [(f"P-{i}", 1, c, "A>G" if (i + j) % 3 else "normal") for i in range(30) for j, c in enumerate(["1", "2", "3", "4", "5"])]
    variants = spark.createDataFrame(rows_, "id string, dementia int, Coordinate string, Variant string")
    excluded = spark.createDataFrame([("P_0",)], "X1 string")
    out, names = combination_vectors(variants, excluded, 2, haplotype=["1", "2"])
    got = {r["id"]: r for r in rows(out)}
    assert len(got) == 29 and "P-0" not in got
    assert any("haplotype" in n for n in names) and all("1_" not in n for n in names)
    # items after collapsing: haplotype, 3, 4, 5
    assert got["P-1"]["n_variant"] == sum([1, int((1 + 2) % 3 > 0), int((1 + 3) % 3 > 0), int((1 + 4) % 3 > 0)])


def test_nearest_neighbours_across_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    y = rng.integers(0, 2, 60)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(60)], "id int, f array<double>, y int")
    got = {}
    for r in rows(models.nearest_neighbours(df.filter("id >= 20"), df.filter("id < 20"), "id", "f", "y", 5, block_rows=7)):
        got.setdefault(r["id"], {})[r["rank"]] = (r["distance"], r["neighbour"])
    for i in range(20):
        d = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(20, 60))[:5]
        assert [got[i][k] for k in range(1, 6)] == d
    votes = {r["id"]: r["prediction"] for r in rows(models.knn_vote(models.nearest_neighbours(df.filter("id >= 20"), df.filter("id < 20"), "id", "f", "y", 5, 7), "id"))}
    assert votes[0] == int(np.mean([y[n] for _, n in [got[0][k] for k in range(1, 6)]]) > .5)


def test_nearest_neighbours_with_many_copies(spark, small_groups):
    train = spark.createDataFrame([(i, [0.0, 1.0] if i < 40 else [float(i), 0.0], i % 2) for i in range(60)], "id int, f array<double>, y int")
    asked = spark.createDataFrame([(100 + i, [0.0, 1.0]) for i in range(30)] + [(200, [45.0, 0.0])], "id int, f array<double>")
    got = {}
    for r in rows(models.nearest_neighbours(train, asked, "id", "f", "y", 3, block_rows=4)):
        got.setdefault(r["id"], {})[r["rank"]] = (r["distance"], r["neighbour"], r["neighbour_label"])
    assert len(got) == 31
    assert all(got[100 + i] == {1: (0.0, 0, 0), 2: (0.0, 1, 1), 3: (0.0, 2, 0)} for i in range(30))
    assert got[200] == {1: (0.0, 45, 1), 2: (1.0, 44, 0), 3: (1.0, 46, 0)}


def test_models_learn(spark):
    rng = random.Random(1)
    data = [(i, rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, c, int(a or b)) for i, a, b, c in data], "id int, a int, b int, c int, y int")
    out = models.compare_models(df, "id", ["a", "b", "c"], "y", trees=10, stages=5)
    scores = {r["model"]: r for r in rows(accuracy.scores(accuracy.confusion_counts(out, "prediction", "y", ["model"])))}
    assert set(scores) == {"Logistic_Regression", "Random_Forest", "K_Neighbors", "Gradient_Boosting"}
    assert all(s["accuracy"] > 0.9 for s in scores.values())


def test_weighted_sample_properties(spark):
    df = spark.createDataFrame([(i, i % 2, 0.0 if i < 10 else 1.0) for i in range(60)], "id int, g int, w double")
    a = sampling.weighted_sample(df, ["g"], "w", 5, ["id"]).collect()
    assert len(a) == 10 and all(r["id"] >= 10 for r in a)
    assert sorted(r["id"] for r in a) == sorted(r["id"] for r in sampling.weighted_sample(df.repartition(5), ["g"], "w", 5, ["id"]).collect())


def test_stack_blocks_and_names(spark):
    df = spark.createDataFrame([("M", "1", "F", "2", None, None), (None, None, "M", "3", "M", "9")], "sex string, PHQ1_1 string, sex2 string, PHQ2_1 string, sex3 string, PHQ3 string")
    rule = [(r"^([A-Za-z]+)\d$", r"\1"), (r"^([A-Za-z]+)\d(_\d+)$", r"\1\2")]
    third = [(r"^(PHQ)(\d)$", r"\1_1"), (r"^([A-Za-z]+)\d$", r"\1")]
    got = sorted(map(tuple, reshape.stack_blocks(df, ["sex", "sex2", "sex3"], [rule, rule, third]).collect()))
    assert got == [("F", "2", 2), ("M", "1", 1), ("M", "3", 2), ("M", "9", 3)]


def test_conform(spark):
    df = spark.createDataFrame([("1", "x")], "b string, extra string")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    out = columns.conform(df, schema)
    assert out.columns == ["a", "b"] and tuple(out.first()) == (None, 1)


def test_drop_rare_columns(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 1)], "a int, b int, c int")
    assert columns.drop_rare_columns(df, ["a", "b", "c"], 1).columns == ["a", "b"]
    assert columns.drop_rare_columns(df, ["a", "b", "c"], 3, keep_at=True).columns == ["a"]


def test_path_model_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=400), rng.normal(size=400)
    m = .5 * a + rng.normal(size=400)
    y = .7 * m - .3 * b + rng.normal(size=400)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, m, y)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, m double, y double")
    edges = {(r["lhs"], r["op"], r["rhs"]): r for r in rows(regression.path_model(df, {"m": ["a"], "y": ["m", "b"]}))}
    X = np.column_stack([np.ones(400), m, b])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    rss = ((y - X @ beta) ** 2).sum() / 400
    se = np.sqrt(rss * np.diag(np.linalg.inv(X.T @ X)))
    assert edges["y", "~", "m"]["est"] == pytest.approx(beta[1]) and edges["y", "~", "m"]["se"] == pytest.approx(se[1])
    assert edges["y", "~", "b"]["std"] == pytest.approx(beta[2] * b.std() / y.std())
    kept, dropped = regression.prune_edges(regression.path_model(df, {"m": ["a", "b"], "y": ["m", "b"]}))
    names = {(r["lhs"], r["op"], r["rhs"]) for r in rows(kept)}
    assert ("y", "~", "m") in names and ("m", "~~", "m") in names
    assert {(r["lhs"], r["rhs"]) for r in rows(dropped)} <= {("m", "b")}


def test_manifest(spark):
    files = [("/d/20200101/fastq/L1/P-12_R1_001.gz", 5), ("/d/20200101/fastq/L1/P-12_R2_001.gz", 5), ("/d/20200102/fastq/L2/AG33_R1_x.gz", 5)]
    out = {r["sample"]: r for r in rows(manifest.read_manifest(spark.createDataFrame(files, "path string, length long"), "G1"))}
    assert out["P-12"]["r2"].endswith("P-12_R2_001.gz") and out["P-12"]["library"] == "20200101" and out["P-12"]["lane"] == "L1"
    assert out["AG33"]["r2"] is None and out["AG33"]["read_group"].endswith("SM:AG33")
    outputs = spark.createDataFrame([("a", "bam", 3), ("a", "txt", 1), ("b", "bam", 3), ("b", "txt", 0)], "s string, kind string, length long")
    done = manifest.completed(outputs, ["s"], "kind", ["bam", "txt"])
    assert [r["s"] for r in manifest.pending(spark.createDataFrame([("a",), ("b",), ("c",)], "s string"), done, ["s"]).orderBy("s").collect()] == ["b", "c"]


def test_missing_quality_never_wins(spark):
    from strataline.operators import ordering
    df = spark.createDataFrame([(1, 10.0, "a"), (1, None, "b"), (1, 5.0, "c"), (2, None, "d"), (2, None, "e")], "pos int, q double, id string")
    out = {r["id"]: r["duplicate"] for r in rows(ordering.flag_duplicates(df, ["pos"], "q", "id"))}
    assert out == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_gene_and_site_without_known_outcome(spark):
    from strataline.operators import genotype, tables
    calls = spark.createDataFrame([("s1", "g1", 1), ("s3", "g2", 2)], "id string, gene string, site int")
    people = spark.createDataFrame([("s1", 0), ("s2", 1), ("s3", None)], "id string, outcome int")
    freq = {(r["gene"], r["outcome"], r["burden"]): r["n"] for r in rows(genotype.burden_frequencies(calls, people, "id", "gene", "outcome", [0, 1]))}
    assert freq == {("g1", 0, 1): 1, ("g1", 1, 0): 1, ("g2", 0, 0): 1, ("g2", 1, 0): 1}
    sites = {r["site"]: r for r in rows(tables.presence_chi_squared(calls, people, "id", ["site"], "outcome"))}
    assert sites[2]["note"] == "single level" and (sites[2]["absent_normal"], sites[2]["absent_patient"]) == (1, 1)


def test_weighted_variance_of_large_values(spark):
    import pytest

    from strataline.operators import means
    df = spark.createDataFrame([("x", 1e8 + v, 1) for v in (0.0, 1.0, 2.0)] + [("y", 1e8 + 10 + v, 2) for v in (0.0, 1.0, 2.0)], "g string, v double, n int")
    got = rows(means.t_test(df, "v", "g", "x", "y", weight="n"))[0]
    assert got["sd_x"] == pytest.approx(1.0) and got["sd_y"] == pytest.approx((4 / 5) ** 0.5) and got["mean_y"] == pytest.approx(1e8 + 11) and got["statistic"] is not None


def test_item_sets_with_separators(spark):
    from strataline.operators import genotype
    sets = [("p", ["a_b", "c", "d"]), ("q", ["a", "b_c", "d"]), ("r", ["a_b", "c", "d"])]
    presence = spark.createDataFrame([(s, i, 1) for s, items in sets for i in items], "id string, item string, present int")
    support = {r["item_set"]: r["support"] for r in rows(genotype.combination_support(presence, "id", "item"))}
    assert sorted(support.values()) == [1, 2] and len(support) == 2
    assert {r["id"] for r in rows(genotype.subject_combinations(presence, "id", "item", 1))} == {"p", "r"}


def test_read_without_header(spark, tmp_path):
    from strataline.sources import readers
    (tmp_path / "x.csv").write_text("p1,a\np2,b\n")
    assert [r["id"] for r in readers.read_positional(spark, str(tmp_path), ["id", "v"], skip=0).orderBy("id").collect()] == ["p1", "p2"]
    assert [r["id"] for r in readers.read_positional(spark, str(tmp_path), ["id", "v"]).collect()] == ["p2"]


def test_unpack_one_very_long_cell(spark):
    from strataline.operators import reshape
    n = 100_000
    df = spark.createDataFrame([("p", "\n".join(str(k) for k in range(n)), "\n".join(str(k) for k in range(n)))], "id string, day string, v string")
    out = reshape.unpack(df, ["day", "v"])
    assert out.count() == n and out.filter("day <> v").count() == 0


def test_hot_keys_get_their_own_exchange(spark):
    """With broadcasting off both sides of the join are dealt by the hash of the key, not by the aggregate's partitioning."""
    from strataline.operators import columns, filters
    from strataline.sources import manifest
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select((F.col("id") % 7).cast("string").alias("k"), "id")
        plans = [columns.drop_rare_features(df, "k", 3), filters.exclude_listed(df, df.select("k"), "k"), manifest.pending(df, df.filter("id < 5"), ["k"])]
        for d in plans:
            text = d._jdf.queryExecution().executedPlan().toString()
            assert text.count("hashpartitioning(__mine") == 1 and text.count("hashpartitioning(__hash") == 1
        assert [d.count() for d in plans] == [100, 0, 100 - sum(1 for k in range(100) if k % 7 < 5)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_intermediates_can_be_deleted(spark):
    import os

    from strataline import session
    session.clean_up(spark)
    base = session.shared_dir(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(base))
    t = session.materialise(spark.range(5).toDF("id"))
    assert t.count() == 5 and len(set(os.listdir(base)) - before) == 1
    assert session.clean_up(spark) == 1 and set(os.listdir(base)) == before


def test_neighbours_by_sets_equal_dense_vectors(spark):
    r = random.Random(4)
    items = [f"i{k}" for k in range(9)]
    data = [(f"s{k:03d}", sorted(r.sample(items, r.randrange(5))), r.randrange(2)) for k in range(90)]
    df = spark.createDataFrame([(s, x, [float(i in x) for i in items], y) for s, x, y in data], "id string, items array<string>, v array<double>, y int")
    train, asked = df.filter("id < 's060'"), df.filter("id >= 's060'")
    for rows_per_block in (1000, 7):
        a = models.nearest_neighbours(train, asked, "id", "v", "y", 3, rows_per_block)
        b = models.nearest_neighbours(train, asked, "id", "items", "y", 3, rows_per_block, sets=True)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
