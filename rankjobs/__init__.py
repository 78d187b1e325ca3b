"""rankjobs: link recommendation over item tables, written as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The small functions that run in Python workers travel with their task, so that
# nothing has to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
