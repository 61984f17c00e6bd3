"""Operators for large training corpora.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Ship the functions of this subpackage with the tasks, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
