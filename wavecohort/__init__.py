"""Grouped-signal analytics as Spark DataFrame operators.

A signal is one row holding an ``array<double>``; signals belong to samples and
samples to groups.  Every operator takes and returns DataFrames and stays lazy
unless its docstring says it runs a job.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to executors carry the package's code with them, so executors need no copy of it.
register_pickle_by_value(sys.modules[__name__])
