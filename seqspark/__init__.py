"""Sequence-window analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: workers don't need this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
