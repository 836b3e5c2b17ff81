"""vigilflow: network-security analytics expressed as Spark DataFrame, SQL and streaming jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions run inside tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
