"""fairshare: allocation analytics as Spark DataFrame operators.

``sources`` reads and writes, ``functions`` are column expressions, ``operators`` take and return
DataFrames, ``plans`` chain them into the tables an analyst works from.
"""

import sys

from pyspark import cloudpickle

# the few functions that run in tasks travel with them, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
