"""Operators of a training-data pipeline: thirteen corpus operators and their registered queries.

Nothing else in the package imports this subpackage.  Functions defined here are pickled by value, so executors need no
copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
