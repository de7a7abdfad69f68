"""linkweave: a Spark-native engine for probabilistic entity resolution."""

import sys

from pyspark import cloudpickle

# executors need not have this package: functions that run there travel with their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])
