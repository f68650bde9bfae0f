"""Operations of a training-data pipeline, one module each, and their queries in ``registry``.

Functions of this subpackage travel to the executors by value, so that those need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
