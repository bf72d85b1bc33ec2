"""Operators that a large training-data pipeline needs, beside the forensic ones.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Executors may not have this package installed: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
