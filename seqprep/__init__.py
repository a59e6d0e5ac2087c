"""Sequence corpus preparation and analysis as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python kernels travel to the tasks by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
