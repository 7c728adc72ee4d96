"""Spark-native analytics for document knowledge bases.

Every operator takes and returns DataFrames; nothing here runs on the driver
except the assembly of plans and a few bounded, documented collects.
"""

import sys

from pyspark import cloudpickle

from corpusmith.session import durable, get_session, load

# functions of this package travel to the executors by value: they need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["durable", "get_session", "load"]
