"""Tidewheel: a time-series analytics engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors may lack this package; functions that run there travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
