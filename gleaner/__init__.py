"""Catalog discovery and analytics on PySpark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
