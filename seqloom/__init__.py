"""seqloom: a PySpark engine for similarity clustering of sequences and text.

Nothing in this package starts a session; every function takes DataFrames (or a
session) and returns lazy DataFrames unless its docstring says otherwise.
"""

from pyspark import cloudpickle as _cloudpickle

# Workers get the package's functions by value, so that a cluster needs no
# installed copy of it.
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
