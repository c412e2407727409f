"""Operators for large-scale text corpora. Nothing outside this subpackage imports it.

Functions that run in Python workers are shipped by value, so that executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
