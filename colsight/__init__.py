"""Automatic tabular analysis on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from colsight.functions import special
from colsight.operators import profile as _profile
from colsight.operators import segment as _segment

# Ship the few Python helpers by value, so executors need no copy of the package.
for _module in (special, _profile, _segment):
    cloudpickle.register_pickle_by_value(sys.modules[_module.__name__])
