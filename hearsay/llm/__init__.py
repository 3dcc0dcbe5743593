"""Operators for training-data pipelines and their registered queries.

Functions of this package travel to the workers by value, so it need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
