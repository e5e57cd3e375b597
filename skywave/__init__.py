"""skywave: a Spark-native analytics engine for radio-monitoring telemetry."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
