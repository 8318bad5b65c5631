"""captionloom: timed-text analytics (words, segments, captions, signals) on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in the tasks travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
