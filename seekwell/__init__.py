"""Context retrieval over text and vectors, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The code of the tasks travels with them, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
