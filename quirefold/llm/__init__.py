"""Operators for building training corpora; nothing else in the library imports this subpackage."""
import sys

from pyspark import cloudpickle

# Worker code travels with the job, so executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
