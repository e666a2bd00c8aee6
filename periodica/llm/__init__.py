"""Operators of a training-data pipeline; nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the workers by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
