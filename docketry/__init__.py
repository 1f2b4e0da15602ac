"""Scanned-document and face-event analytics as Spark DataFrame operators.

``functions``  column expressions (text cleaning, ID detectors, similarity, geometry)
``operators``  DataFrame -> DataFrame building blocks
``sources``    readers and writers
``plans``      whole jobs built from the operators
``streaming``  Structured Streaming forms of the same jobs
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
