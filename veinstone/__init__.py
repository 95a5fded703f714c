"""Evidence-first retrieval and document processing as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
