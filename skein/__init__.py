"""skein: relational, spatial, full-text and vector analytics expressed as Spark plans."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to Python workers travel with their code, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
