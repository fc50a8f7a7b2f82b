"""From variant calls to classifier input: presence, haplotype, combinations, support, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.filters import exclude_listed
from ..operators.genotype import collapse_haplotype, subject_combinations
from ..operators.models import item_features
from ..operators.reshape import burden, presence_rows
from ..session import materialise


def combination_vectors(variants: DataFrame, excluded: DataFrame | None, threshold: int = 5,
                        haplotype: Sequence = (), subject: str = "id", outcome: str = "dementia",
                        coordinate: str = "Coordinate", variant: str = "Variant") -> tuple[DataFrame, list[str]]:
    """Subjects with outcome, burden and a sparse vector over supported variant combinations.

    A haplotype replaces its coordinates before burden and combinations are formed.
    """
    rows = exclude_listed(variants, excluded, subject) if excluded is not None else variants
    presence = presence_rows(rows, subject, outcome, coordinate, variant)
    if haplotype:
        presence = collapse_haplotype(presence, subject, outcome, coordinate, haplotype)
    presence = materialise(presence)  # read for the burden and for the combinations
    people = burden(presence, subject, outcome)
    items = subject_combinations(presence, subject, coordinate, threshold)
    return item_features(items, people, subject, threshold=threshold)
