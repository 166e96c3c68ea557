"""A PySpark-native engine for document layout, text and image-plan data.

Functions of this package that run on executors travel by value, so that workers need no installation of it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
