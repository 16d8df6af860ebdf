"""Operators for preparing training text. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Python workers get this folder's functions with the plan: nothing need be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
