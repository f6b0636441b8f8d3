"""brindle: a PySpark-native engine for text corpora, dependency graphs and byte-level checks."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# What runs on executors travels with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
