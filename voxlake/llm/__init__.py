"""Operators for preparing language-model training data. Nothing else imports this."""

import sys

from pyspark import cloudpickle

# Tasks get this package's code with the job, wherever the session was started.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
