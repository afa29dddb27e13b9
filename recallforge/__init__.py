"""PySpark engine for building, retrieving from and evaluating passage corpora.

``operators`` holds DataFrame-to-DataFrame transformations, ``functions`` column
expressions, ``sources`` readers and writers, ``plans`` whole pipelines and
``streaming`` the incremental variants.
"""

import sys

from pyspark import cloudpickle

# Python functions shipped to executors travel by value, so a cluster's workers
# need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
