"""Semantic response caching over Spark tables and streams of prompts."""

import sys

from pyspark import cloudpickle

# The small kernels that run inside Python tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
