"""Queries over the driver's tables, each with the same question in SQL."""

import sys

from pyspark import cloudpickle

# Stand-in models run in tasks; executors need no copy of this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
