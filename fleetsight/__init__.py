"""Fleet-wide detection analytics over endpoint telemetry, built on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Tasks get this package's functions by value, so executors need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
