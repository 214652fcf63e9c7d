"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Its functions run
inside Python workers, so the package is shipped by value: executors need no
copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
