"""PySpark-native analytics for policy, product-knowledge and event data."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
