"""Spark-native name matching, record linkage and data preparation."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors whole, so none needs it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
