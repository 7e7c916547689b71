"""Spark-native analytics over agent trajectories.

The package is shipped to executors with the functions that use it, so that
a job needs no installation step on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
