"""Training-data operators on Spark: ten operators, their queries and DuckDB statements.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
