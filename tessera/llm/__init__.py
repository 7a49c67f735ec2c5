"""Operators for large training corpora; nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value.  Modules that they name
# are imported there, so workers need the package on their path (PYTHONPATH, --py-files).
cloudpickle.register_pickle_by_value(sys.modules["tessera.llm"])
