"""Sensor and equipment telemetry analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions with the task, so that nothing
# has to be installed on the executors or to be on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
