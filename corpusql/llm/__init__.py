"""Operators for preparing training text. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
