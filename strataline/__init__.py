"""Cohort and genotype analytics as Spark jobs: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# the few Arrow functions travel with their tasks, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
