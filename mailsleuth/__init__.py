"""Mail-threat analytics as Spark jobs: every rule is a column expression, join, window or aggregation."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions of the package travel to the executors by value, so workers need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
