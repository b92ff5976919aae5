"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Functions that run inside tasks are sent with the task (pickled by value), so
executors need numpy and pyarrow but no copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
