"""Operators for building language-model training data.

Nothing else in the library imports this subpackage. Its task functions travel with the
tasks, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
