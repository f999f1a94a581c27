"""Noveltide: a Spark-first analytics engine for scoring text collections.

Everything is expressed as DataFrame or SQL plans; see ``noveltide.plans`` for
the composed queries and ``noveltide.operators`` for the building blocks.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
