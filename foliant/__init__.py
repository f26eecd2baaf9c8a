"""Foliant: document analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that no worker needs the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
