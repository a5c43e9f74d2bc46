"""Quarryline: security-corpus analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# executors that don't have this package get its Python functions with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])
