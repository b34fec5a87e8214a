"""Evaluate models on large labelled datasets with Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors inside the task, so the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
