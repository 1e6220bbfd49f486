"""Entity-year survey analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions run on executors are shipped by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources"]
