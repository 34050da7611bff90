"""threadloom: chat and conversation data processing on PySpark.

Every operator is a function from DataFrames to a DataFrame (or from columns to
a column); Spark plans, shuffles and runs all of it.
"""

import sys

from pyspark import cloudpickle

from threadloom.config import ChatConfig

# Send the few Python functions to the executors as code, so that the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ChatConfig"]
