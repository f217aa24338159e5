"""Operators of a training-data pipeline: deduplication, search, language and
quality models, packing, token counts and mixing.

Nothing else in the library imports this subpackage.  Its functions travel to
executors by value, so a cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
