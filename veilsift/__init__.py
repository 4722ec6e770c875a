"""Sensitive-data discovery, classification and masking on Spark."""

import sys

from pyspark import cloudpickle

# Python kernels travel with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
