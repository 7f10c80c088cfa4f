"""Spark-native HTTP parameter-anomaly analytics."""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers inside the tasks: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
