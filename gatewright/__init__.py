"""gatewright: software-security signals as Spark tables.

Every table carries ``(repo_id, run_id)``; every operator is a DataFrame-to-DataFrame function that handles
all repositories and runs at once.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel inside the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
