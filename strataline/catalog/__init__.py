"""All registered queries. Importing this package fills the register."""

from . import cleaning, comparisons, files, linkage, raters, shaping, variants, visits  # noqa: F401
from .registry import QUERIES, Query  # noqa: F401
