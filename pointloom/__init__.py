"""pointloom: a PySpark-native analytics engine for labelled point-cloud recordings."""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Functions that run on executors are shipped with the plan, so a cluster needs no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
