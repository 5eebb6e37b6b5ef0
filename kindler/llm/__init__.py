"""Training-data operators: formatting, duplicates, quality, packing, filters.

Nothing else in the library imports this subpackage.  Functions that run on
executors are pickled by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
