"""corpusmill: corpus quality, lexical retrieval and evaluation analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel with their plan: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
