"""Invoice-document analytics as plain Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the task, so it need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
