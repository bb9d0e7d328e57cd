"""Factory document, PLC, telemetry and chat analytics as PySpark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Helpers of Pandas functions travel to the executors with the job, so no package has to be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
