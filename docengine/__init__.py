"""Document-corpus analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks, so executors
# need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
