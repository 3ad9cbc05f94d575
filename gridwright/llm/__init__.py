"""Operators of a training-data pipeline. Nothing else in the library imports
this subpackage. Python code of these modules is shipped to workers by value,
so executors need not have the package on their path."""

import sys as _sys

from pyspark import cloudpickle as _cp

_cp.register_pickle_by_value(_sys.modules[__name__])
