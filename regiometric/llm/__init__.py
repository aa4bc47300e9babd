"""Preparation of text corpora for language-model training. Nothing else in the package imports this subpackage.

The helpers that run inside tasks travel with the job, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
