"""Operators for preparing language-model training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks get the code of their functions with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
