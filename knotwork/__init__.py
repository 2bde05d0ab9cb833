"""knotwork: typed knowledge connections as PySpark DataFrame operators.

Functions shipped to Python workers are pickled by value, so executors need
only pyspark, pyarrow, numpy, pandas (and duckdb, regex for ``llm``), not this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
