"""Step-chart and beat-grid analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that a cluster does not need
# this package installed on every machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ("functions", "operators", "plans", "sources", "streaming")
