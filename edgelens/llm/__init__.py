"""Training-data operators: duplicates, quality, filters, mixing, sharding, counts.

Their task functions travel to the executors by value, so a cluster needs no copy
of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
