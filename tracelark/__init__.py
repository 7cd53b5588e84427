"""tracelark: a Spark-native engine for auditing collections of research documents.

Everything set-oriented is a DataFrame plan; see README.md for the map of modules.
The subpackage ``llm`` holds the operators for training text and is optional:
nothing outside of it imports it.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
