"""Document-corpus analytics on Spark: every operator is DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
