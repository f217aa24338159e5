"""Operators: functions from DataFrames to a DataFrame.

Python that runs in tasks travels by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
