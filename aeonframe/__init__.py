"""Spark-first analytics for records with uncertain dates and named places."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
