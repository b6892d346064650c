"""knowloom: knowledge-transfer analytics over repositories, documents and commit history, on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the functions of this package by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
