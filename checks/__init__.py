"""Registered queries over the given tables and the SQL each must agree with."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
