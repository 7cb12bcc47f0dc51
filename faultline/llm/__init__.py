"""Operators of a training-data pipeline. Nothing else in the package imports this folder.

The functions that run inside tasks are pickled by value, so executors need numpy, pandas and
pyarrow, but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
