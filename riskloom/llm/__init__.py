"""Operators for training-data pipelines. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this package by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
