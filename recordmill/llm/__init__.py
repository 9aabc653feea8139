"""Operators for training-data pipelines. Nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# functions sent to Python workers travel by value, so executors need no copy of this package
register_pickle_by_value(sys.modules[__name__])
