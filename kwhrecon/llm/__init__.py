"""Operations of a training-data pipeline: scoring, tokens, dedup, search, mixing.

Each module holds one operator with a general interface; ``queries`` derives
the registered ``opN_<name>`` queries from them. Functions of this package
travel to the executors by value, so a worker needs no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
