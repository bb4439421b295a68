"""Columnar archive analytics on PySpark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to Python workers by value, so executors needn't have it installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
