"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage.  Its functions are shipped to Python
workers by value, so executors need numpy, pyarrow and the tokenizer library, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
