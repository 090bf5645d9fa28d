"""Weighted survey and cohort analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their task, so executors need
# neither an installed copy of this package nor the driver's working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
