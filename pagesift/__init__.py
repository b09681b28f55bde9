"""Web-search extraction and ranking over tables of captured pages, on Spark."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions to executors by value, so that a cluster needs
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
