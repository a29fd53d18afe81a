"""Skein: code graphs, search and knowledge bundles as PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: a cluster need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
