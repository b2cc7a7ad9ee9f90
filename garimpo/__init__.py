"""Spark-native document search, indexing and corpus preparation.

The package is pickled by value, so executors need no copy of it: a cluster
only has to offer the third-party libraries that the workers import.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
