"""Ticket triage and text similarity on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# The two scoring functions travel to the workers whole, so a worker needs only
# numpy and pyarrow, not this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
