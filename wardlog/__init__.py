"""Spark-native analytics over HTTP, DNS and login logs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers are shipped by value: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
