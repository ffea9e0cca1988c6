"""Training-data operators: ten corpus operators and the pieces shared by their queries."""
import sys

from pyspark import cloudpickle

# task functions travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
