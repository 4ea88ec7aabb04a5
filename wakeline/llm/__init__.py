"""Operators for training-data pipelines.

Functions that run in Python workers are pickled with their code, so executors need no copy of
this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
