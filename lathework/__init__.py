"""lathework: worksheet and document analytics written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no installed copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
