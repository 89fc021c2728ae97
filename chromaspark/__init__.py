"""Chromatography method analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value, so clusters need no package installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
