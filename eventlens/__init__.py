"""Event aggregation on Spark: every operator maps DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python tasks receive the package's functions by value, so that executors and
# the driver's streaming worker need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
