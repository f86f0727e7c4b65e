"""The registered queries: each operator on the given tables, with the SQL that must give the same rows."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
