"""A PySpark analytics engine for file and media catalogs."""

import sys

from pyspark import cloudpickle

# Executors need not have this repository on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
