"""Message-corpus and request-log analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the query, so
# executors need neither this package installed nor the driver's path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
