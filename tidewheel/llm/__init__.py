"""Operators for training-data pipelines.  Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import tidewheel.llm.kernels  # noqa: F401

# Executors may lack this package; functions travel by value.
import tidewheel.llm as _self

cloudpickle.register_pickle_by_value(_self)
