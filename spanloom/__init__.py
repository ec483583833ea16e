"""Spark-native analytics for interval, sequence, assay and corpus data."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
