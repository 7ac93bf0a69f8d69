"""Training-data operators; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# executors need not be able to import this package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
