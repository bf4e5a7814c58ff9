"""Operators for preparing training text.  Nothing outside this folder imports it."""

from pyspark import cloudpickle

import choicemeter

# Functions that run in tasks travel with the job; workers need no copy of the repository.
cloudpickle.register_pickle_by_value(choicemeter)
