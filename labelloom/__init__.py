"""Spark-native dataset quality, label harmonisation and catalog engine.

Every operator is a function from DataFrames to a DataFrame: nothing runs until
the caller acts on the result, so Catalyst sees the whole plan. Task functions travel with
the tasks, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
