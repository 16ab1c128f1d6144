"""Operators that prepare training data: near-duplicates, mixing, packing, filters, sharding and search.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their job, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
