"""Training-data operators: one module per operator, all on whole DataFrames.

Nothing else in the library imports this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to Python workers by value, so executors need
# not have the package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
