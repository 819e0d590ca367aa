"""Spark operators for market-attention analytics.

Posts, daily bars, FX rates, alias lists and lexicons go in; mention trends,
sentiment rollups, forward returns, features, signals, alerts and overview
tables come out.  Every operator is a function over DataFrames, takes an
explicit ``as_of`` where time matters and runs no action of its own unless its
docstring says so.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job; workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
