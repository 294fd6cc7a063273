"""Operators for building language-model training data; nothing outside this folder imports them.

Python that runs inside tasks is sent to the executors by value, so they need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
