"""PySpark-native engine for text memory: retrieval, fusion, history, graphs, consolidation and synthesis as DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves: executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
