"""A PySpark-native engine for image batches, publish planning and training-data preparation."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
