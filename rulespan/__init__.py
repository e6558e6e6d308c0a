"""Data-quality rules, evaluated as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their jobs, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
