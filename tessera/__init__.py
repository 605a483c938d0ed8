"""Spark-first engine for turning cited text into verifiable learning datasets."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so workers need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
