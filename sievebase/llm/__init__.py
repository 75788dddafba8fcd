"""Operators for preparing training data: sharding, packing, filtering, near-duplicates, scoring.

Nothing outside this folder imports it.  Every operator takes a DataFrame and returns one; the
``opN_*`` queries in :mod:`sievebase.llm.queries` bind them to the driver's tables.
"""

import sys

from pyspark import cloudpickle

# Functions for Arrow batches travel with their code: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
