"""Training-data operators. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so a cluster need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
