"""Training-data operators: ten Spark operators over documents, pages and benchmark items.

Task functions are shipped to executors by value, so a cluster needs no copy
of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
