"""Correlated dataset search over a data lake, written as Spark plans.

Given a query table with one text key and one numeric measure, the package
finds (table, key column, measure column) triples of a lake that join on the
key and correlate in the measure, either through a sketch index or exactly.
"""

import sys

from pyspark import cloudpickle

from lakekin.options import PAIR, SketchOptions

__all__ = ["PAIR", "SketchOptions"]

# Functions that run in tasks travel by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
