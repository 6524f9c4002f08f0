"""Operators for preparing training data at scale."""

import sys

from pyspark import cloudpickle

# Tasks carry this subpackage's code along, so that workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
