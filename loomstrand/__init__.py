"""Loomstrand: sequence binning and corpus preparation expressed as Spark plans."""

from pyspark import cloudpickle
import sys

# Functions shipped to Python workers travel by value: executors need not have
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
