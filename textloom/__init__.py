"""textloom: routing, rendering and batch processing of texts on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so nothing has
# to be installed there and no search path has to be set.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
