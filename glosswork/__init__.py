"""A data quality engine for captions and other short texts, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the tasks, so that it needn't be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
