"""millwright: data preparation, pipeline repair and corpus tools on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
