"""Operators of a training-data pipeline (one module per operator).

Nothing else in the library imports this subpackage.  Functions shipped to
Python workers are pickled by value, so that executors need no copy of the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
