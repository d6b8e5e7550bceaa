"""Spark-native analytics for weighted interval records, transcripts and reads."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so a worker needs no
# copy of this package on its own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
