"""Marketplace listing analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel with them, so executors need no
# installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
