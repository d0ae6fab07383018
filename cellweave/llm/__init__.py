"""Operators for preparing text corpora: deduplication, filtering, scoring, mixing, sharding, packing, search."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the job, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
