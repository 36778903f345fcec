"""Spark-native clustering of sparse pair tables.

The public entry points are :func:`pairweave.plans.cluster.cluster` (one call from a pair table to an
assignment table), the building blocks in :mod:`pairweave.operators` and the readers and writers in
:mod:`pairweave.sources`.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# executors needn't have the package installed: functions travel with their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])
