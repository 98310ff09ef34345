"""gridloom: raster, vector-layer and time-series analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python workers need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
