"""reviewlens: topic and sentiment mining of large review collections on Spark.

Every operator takes and returns Spark DataFrames.  Row-sized data stays on the
executors; only frames whose size is bounded by a parameter (topics, capped
vocabularies, metric rows) reach the driver.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel inside the tasks that use them, so executors
# do not need it installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
