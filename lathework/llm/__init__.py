"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy of this subpackage.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
