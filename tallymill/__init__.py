"""Retail sales analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the task, so the workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
