"""Conversational-recommendation data engine on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the engine's functions with the plan: nothing need be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
