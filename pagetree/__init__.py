"""Page-structure analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions sent to workers travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
