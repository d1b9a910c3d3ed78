"""Operators over text corpora.  Nothing else in the library imports this subpackage.

Functions that run on the executors travel with the job (pickled by value), so
the executors need the third-party libraries but no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
