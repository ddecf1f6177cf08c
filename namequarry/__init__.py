"""Spark-native operators for marketplace name data."""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Functions that run in Python workers travel with the plan, so executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
