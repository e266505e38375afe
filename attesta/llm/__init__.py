"""Operators for preparing training text. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the job and need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
