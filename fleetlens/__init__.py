"""Operational-log and host-snapshot analytics on the Spark DataFrame API."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the plan, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
