"""Operators for preparing training data of language models, on DataFrames of documents, pages and vectors."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of these modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
