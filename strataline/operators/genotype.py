"""Variant calls: grids, presence, variant combinations, carriers and frequencies by outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..session import materialise
from .joins import left_join
from .ordered import frequencies
from .reshape import indicator_columns
from .sampling import stratified_sample
from .skew import attach


def outcome_from_id(subject: str | Column, control_prefix: str = "N") -> Column:
    """0 for ids of the control series, else 1."""
    c = F.col(subject) if isinstance(subject, str) else subject
    return F.when(c.startswith(control_prefix), 0).when(c.isNotNull(), 1)


def gene_grid(subjects: DataFrame, coordinates: DataFrame, within: Sequence[str] = (), spread: int | None = None) -> DataFrame:
    """All subjects (also those without any call) at all coordinates."""
    from .joins import grid
    return grid(subjects, coordinates, within, spread)


def variant_table(calls: DataFrame, subjects: DataFrame, consequences: Sequence[str], gene: str | None = None) -> DataFrame:
    """Annotated grid of form-1 calls ``(id, Gene, Coordinate, Variant, Genotype, Exonic, Consequence)``.

    With ``gene=None`` all genes are done at once and ``Gene`` stays a column. Absent calls become
    normal / wild type / not exonic; one 0/1 column per consequence; outcome from the id.
    """
    if gene is not None:
        calls = calls.filter(F.col("Gene") == gene)
    calls = calls.withColumn("id", F.regexp_replace("id", "_", "-"))
    people = subjects.select(F.regexp_replace("id", "_", "-").alias("id")).distinct()
    cells = gene_grid(people, calls.select("Gene", "Coordinate").distinct())
    out = left_join(cells, calls, ["id", "Gene", "Coordinate"], na_matches=False)
    out = out.na.fill({"Variant": V.NORMAL, "Genotype": V.WILD_TYPE, "Exonic": "no"})
    out = out.withColumn("Genotype", X.recode("Genotype", V.GENOTYPE_NAMES))
    out = indicator_columns(out, "Consequence", consequences).drop("Consequence")
    return out.withColumn("dementia", outcome_from_id("id"))


def annotated_table(calls: DataFrame, subjects: DataFrame) -> DataFrame:
    """Grid of form-2 calls ``(master_no, gene, coordinate, Ref, func, Alt, exonic_func, genotype)``
    over all genes in one job."""
    sites = calls.select("gene", "coordinate", "Ref", "func").distinct()
    cells = gene_grid(subjects.select("master_no").distinct(), sites)
    seen = calls.select("master_no", "gene", "coordinate", "Alt", "exonic_func", "genotype")
    out = left_join(cells, seen, ["master_no", "gene", "coordinate"], na_matches=False)
    kind = F.coalesce(F.col("exonic_func"), F.lit(V.NORMAL))
    label = F.when(kind == V.INTRONIC[0], V.INTRONIC[1]).otherwise(kind)
    genotype = F.col("genotype")
    named = F.when(genotype == "hom", V.GENOTYPE_NAMES["hom"]).when(genotype == "het", V.GENOTYPE_NAMES["het"])
    return out.select(
        "master_no", "gene", named.otherwise(V.WILD_TYPE).alias("genotype"), "coordinate", "Ref",
        F.when(kind == V.NORMAL, F.col("Ref")).otherwise(F.col("Alt")).alias("Alt"), "func",
        label.alias("exonic_func"), outcome_from_id("master_no").alias("dementia"))


def annotated_counts(calls: DataFrame, subjects: DataFrame) -> DataFrame:
    """Cells of ``annotated_table`` per site, kind, genotype, allele and outcome, without building the grid.

    Cells with a call are counted from the calls; normal cells are subjects minus carriers.
    """
    people = subjects.select("master_no").distinct().withColumn("dementia", outcome_from_id("master_no"))
    sites = calls.select("gene", "coordinate", "Ref", "func").distinct()
    seen = calls.select("master_no", "gene", "coordinate", "Alt", "exonic_func", "genotype").join(people, "master_no")
    genotype = F.when(F.col("genotype") == "hom", V.GENOTYPE_NAMES["hom"]).when(
        F.col("genotype") == "het", V.GENOTYPE_NAMES["het"]).otherwise(V.WILD_TYPE)
    kind = F.coalesce(F.col("exonic_func"), F.lit(V.NORMAL))
    label = F.when(kind == V.INTRONIC[0], V.INTRONIC[1]).otherwise(kind)
    keys = ["gene", "coordinate", "exonic_func", "genotype", "Alt", "dementia"]
    counted = seen.join(sites, ["gene", "coordinate"]).select(
        "gene", "coordinate", label.alias("exonic_func"), genotype.alias("genotype"),
        F.when(kind == V.NORMAL, F.col("Ref")).otherwise(F.col("Alt")).alias("Alt"), "dementia").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    size = lambda v: people.agg(F.count_if(F.col("dementia") == v)).scalar()
    carriers = seen.select("master_no", "gene", "coordinate", "dementia").distinct().groupBy("gene", "coordinate").agg(
        F.count_if(F.col("dementia") == 0).alias("c0"), F.count_if(F.col("dementia") == 1).alias("c1"))
    left = lambda v: F.struct(F.lit(v).alias("dementia"), (size(v) - F.coalesce(F.col(f"c{v}"), F.lit(0))).alias("n"))
    absent = sites.join(carriers, ["gene", "coordinate"], "left").select(
        "gene", "coordinate", F.lit(V.NORMAL).alias("exonic_func"), F.lit(V.WILD_TYPE).alias("genotype"), F.col("Ref").alias("Alt"),
        F.explode(F.array(left(0), left(1))).alias("x")).select(*keys[:5], "x.dementia", "x.n")
    return counted.unionByName(absent.filter("n > 0")).groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n"))


def burden_frequencies(calls: DataFrame, subjects: DataFrame, subject: str, gene: str, outcome: str,
                       levels: Sequence) -> DataFrame:
    """How many subjects of each outcome carry 0, 1, 2 … variants of each gene: ``(gene, outcome, burden, n)``.

    The zeros come from the group sizes, not from a subjects × genes grid. ``subjects`` has one row
    per subject with its outcome; ``calls`` one row per variant with subject and gene.
    """
    people = subjects.filter(F.col(outcome).isin(list(levels))).select(subject, outcome)
    per_subject = calls.groupBy(subject, gene).agg(F.count(F.lit(1)).alias("burden"))
    carriers = per_subject.join(people, subject)
    seen = materialise(frequencies(carriers, [gene, outcome], "burden"))  # small; read twice below
    sizes = people.groupBy(outcome).agg(F.count(F.lit(1)).alias("__all"))
    counted = [F.struct(F.lit(v).alias(outcome), F.coalesce(F.sum(F.when(F.col(outcome) == v, F.col("n"))), F.lit(0))
                        .alias("__seen")) for v in levels]
    # a gene whose carriers all lack a known outcome has burden 0 for everybody
    genes = calls.filter(F.col(gene).isNotNull()).select(gene).distinct().withColumns({outcome: F.lit(levels[0]), "n": F.lit(0).cast("bigint")})
    zero = seen.select(gene, outcome, "n").unionByName(genes).groupBy(gene).agg(F.array(*counted).alias("__g")).select(gene, F.explode("__g").alias("__g"))
    zero = zero.select(gene, "__g.*").join(sizes, outcome).select(
        gene, outcome, F.lit(0).cast("bigint").alias("burden"), (F.col("__all") - F.col("__seen")).alias("n"))
    return materialise(seen.unionByName(zero.filter(F.col("n") > 0)))


def collapse_haplotype(presence: DataFrame, subject: str, outcome: str, coordinate: str, members: Sequence,
                       name: str = "haplotype") -> DataFrame:
    """Replace the member coordinates of a long presence table by one item, present when any member is."""
    item = F.when(F.col(coordinate).isin(list(members)), F.lit(name)).otherwise(F.col(coordinate).cast("string"))
    return presence.groupBy(subject, outcome, item.alias(coordinate)).agg(F.max("present").alias("present"))


def item_sets(presence: DataFrame, subject: str, item: str, frequent_above: int = 0) -> DataFrame:
    """Present items per subject: ``(subject, size, items)``.

    ``size`` counts all present items; ``items`` is sorted and, with ``frequent_above``, restricted
    to items with more support than that. A set has at most as many items as there are coordinates,
    and repeats are dropped before the shuffle.
    """
    present = presence.filter(F.col("present") == 1).select(subject, F.col(item).cast("string").alias("__item"))
    if not frequent_above:
        sets = present.groupBy(subject).agg(F.sort_array(F.collect_set("__item")).alias("items"))
        return sets.select(subject, F.size("items").cast("bigint").alias("size"), "items")
    present = present.distinct()
    support = present.groupBy("__item").agg(F.count(F.lit(1)).alias("__n"))
    kept = attach(present, support, ["__item"], "__n").withColumn("__keep", F.col("__n") > frequent_above)
    return kept.groupBy(subject).agg(
        F.count(F.lit(1)).alias("size"),
        F.sort_array(F.collect_list(F.when(F.col("__keep"), F.col("__item")))).alias("items"))


def _marked(sets: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Items as they stand in the text of a set: an underscore or backslash inside an item gets a backslash in front."""
    return sets.select(*keep, "size", F.transform("items", lambda x: F.regexp_replace(x, r"([_\\])", r"\\$1")).alias("items"))


def _exact(base: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The whole set of subjects that have one or two items."""
    exact = base.filter(F.col("size").isin(1, 2) & (F.size("items") == F.col("size")))
    return exact.select(*keep, F.col("size").cast("int").alias("k"), F.array_join("items", "_").alias("item_set"))


def _after(p: str) -> Column:
    """The items behind place ``p``."""
    return F.slice("items", F.col(p) + 2, F.greatest(F.size("items") - F.col(p) - 1, F.lit(0)))


def combinations(sets: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Item sets of size 3, 2 and 1 from rows ``(keep…, size, items)``.

    Size 3: any three present items. Sizes 2 and 1: only when the subject has exactly that many.
    Items are taken one level at a time, so no row ever holds all triples of a subject. The text of a set joins
    its items with "_"; an underscore or backslash inside an item gets a backslash in front, so no two sets share a text.
    """
    base = _marked(sets, keep)
    first = base.filter(F.size("items") >= 3).select(*keep, "items", F.posexplode("items").alias("p", "a"))
    first = first.select(*keep, "a", _after("p").alias("items")).filter(F.size("items") >= 2)
    second = first.select(*keep, "a", "items", F.posexplode("items").alias("p", "b"))
    second = second.select(*keep, "a", "b", _after("p").alias("items")).filter(F.size("items") >= 1)
    triples = second.select(*keep, "a", "b", F.explode("items").alias("c"))
    three = triples.select(*keep, F.lit(3).alias("k"), F.concat_ws("_", "a", "b", "c").alias("item_set"))
    return three.unionByName(_exact(base, keep))


def supported_pairs(patterns: DataFrame, threshold: int) -> DataFrame:
    """Adjacency lists of the pairs that more than ``threshold`` subjects with three items or more have: ``(item, later)``.

    ``patterns``: rows ``(size, items, n)``. Subjects with two items are left out, since a triple gains nothing from them. A list is at
    most as long as there are frequent items."""
    base = _marked(patterns, ["n"]).filter(F.size("items") >= 3)
    first = base.select("n", "items", F.posexplode("items").alias("p", "item")).select("n", "item", F.explode(_after("p")).alias("other"))
    pairs = first.groupBy("item", "other").agg(F.sum("n").alias("n")).filter(F.col("n") > threshold)
    return pairs.groupBy("item").agg(F.sort_array(F.collect_list("other")).alias("later"))


def candidate_triples(sets: DataFrame, pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Triples ``(keep…, a, b, c)`` all of whose pairs are in the adjacency lists ``pairs``; no other triple is formed."""
    base = _marked(sets, keep).filter(F.size("items") >= 3)

    def meet(rows: DataFrame, item: str) -> DataFrame:
        # the computed key gives both sides an exchange of their own, so an item that a third of the subjects have can be split
        lists = pairs.select(F.col("item").alias("__item"), "later", F.xxhash64("item").alias("__list"))
        rows = rows.withColumn("__key", F.xxhash64(item))
        joined = rows.join(lists, (F.col("__key") == F.col("__list")) & (F.col(item) == F.col("__item")))
        return joined.withColumn("items", F.array_intersect("items", "later")).drop("__item", "later", "__list", "__key")

    first = base.select(*keep, "items", F.posexplode("items").alias("p", "a")).select(*keep, "a", _after("p").alias("items"))
    first = meet(first.filter(F.size("items") >= 2), "a").filter(F.size("items") >= 2)  # kept in order: b before c
    second = first.select(*keep, "a", "items", F.posexplode("items").alias("p", "b")).select(*keep, "a", "b", _after("p").alias("items"))
    second = meet(second.filter(F.size("items") >= 1), "b")
    return second.select(*keep, "a", "b", F.explode("items").alias("c"))


def _supported(sets: DataFrame, pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``combinations`` without the triples that have a pair below the threshold."""
    three = candidate_triples(sets, pairs, keep).select(*keep, F.lit(3).alias("k"), F.concat_ws("_", "a", "b", "c").alias("item_set"))
    return three.unionByName(_exact(_marked(sets, keep), keep))


def subject_combinations(presence: DataFrame, subject: str, item: str, threshold: int = 0) -> DataFrame:
    """Item-set rows per subject; with a threshold only sets with more support than it."""
    sets = item_sets(presence, subject, item, threshold)
    if not threshold:
        return combinations(sets, [subject])
    sets = materialise(sets)  # read again for the pairs, the support and the rows
    patterns, pairs = _patterns(sets, threshold)
    kept = _support(patterns, pairs, threshold).select(F.xxhash64("item_set").alias("__key"), F.col("item_set").alias("__set"))
    rows = _supported(sets, pairs, [subject]).withColumn("__key", F.xxhash64("item_set"))
    # the computed key gives both sides an exchange of their own, so a very common set can be split at run time
    return rows.join(kept, (rows["__key"] == kept["__key"]) & (rows["item_set"] == kept["__set"]), "left_semi").drop("__key")


def combination_support(presence: DataFrame, subject: str, item: str, threshold: int = 0) -> DataFrame:
    """Number of subjects per item set, above the threshold.

    Equal sets are counted once with their weight. A triple needs more support than the threshold in each of its items and
    in each of its pairs, so rarer items go first, pairs are counted next, and triples are formed from supported pairs alone.
    """
    return _support(*_patterns(item_sets(presence, subject, item, threshold), threshold), threshold)


def _patterns(sets: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame | None]:
    """Different item sets with their number of subjects, and the supported pairs (none without a threshold)."""
    patterns = sets.groupBy("size", "items").agg(F.count(F.lit(1)).alias("n"))
    if not threshold:
        return patterns, None
    patterns = materialise(patterns)  # read for the pairs and for the triples
    return patterns, materialise(supported_pairs(patterns, threshold))


def _support(patterns: DataFrame, pairs: DataFrame | None, threshold: int) -> DataFrame:
    spread = combinations(patterns, ["n"]) if pairs is None else _supported(patterns, pairs, ["n"])
    return spread.groupBy("k", "item_set").agg(F.sum("n").cast("bigint").alias("support")).filter(
        F.col("support") > threshold)


def carrier_table(variants: DataFrame, coordinate, keep: Sequence[str] = ("id", "dementia")) -> DataFrame:
    """Carrier and homozygote flags at one coordinate from ``Variant`` and the ``apoe`` genotype text."""
    return variants.filter(F.col("Coordinate") == coordinate).select(
        *keep, X.carrier("Variant", "G").alias("g_carrier"), X.homozygote("Variant", "G").alias("g_hom"),
        X.allele_carrier("apoe", "E4").alias("e4_carrier"), X.allele_homozygote("apoe", "E4").alias("e4_hom"))


def share_by_outcome(calls: DataFrame, subject: str, coordinate: str, outcome: str) -> DataFrame:
    """Per coordinate: carriers and shares by outcome, and whether cases have the larger share."""
    pairs = calls.select(subject, coordinate, outcome).distinct()
    out = pairs.groupBy(coordinate).agg(
        F.count_if(F.col(outcome) == 0).alias("n_normal"), F.count_if(F.col(outcome) == 1).alias("n_patient"))
    total = F.col("n_normal") + F.col("n_patient")
    out = out.withColumns({"normal_prop": F.try_divide(F.col("n_normal"), total),
                           "patient_prop": F.try_divide(F.col("n_patient"), total)})
    return out.withColumn("higher_in_patients", (F.col("n_patient") > F.col("n_normal")).cast("int"))


def recheck_sample(flags: DataFrame, calls: DataFrame, subject: str, flag: str, coordinate: str,
                   coordinates: Sequence, n: int = 25, seed: int = 20201012) -> DataFrame:
    """Sample subjects per flag value and put their raw calls at the coordinates beside them."""
    drawn = stratified_sample(flags.filter(F.col(flag).isNotNull()).select(subject, flag), [flag], n, [subject], seed)
    return left_join(drawn, calls.filter(F.col(coordinate).isin(list(coordinates))), [subject], na_matches=False)
