"""Financial panel and forecast analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their tasks, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
