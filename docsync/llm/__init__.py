"""Operators for preparing large text corpora; nothing outside this folder imports them.

The functions that run inside tasks travel with the job by value, so executors need only the
public libraries, not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
