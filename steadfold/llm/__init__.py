"""Operators for preparing training corpora.  Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
