"""Similarity analytics over large sets of equal-length time series, on Spark."""
import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
