"""Spark-native document search and text analytics.

Functions that run on executors are sent with their code, so that a cluster
needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
