"""Operations of a training-data pipeline. Functions of this subpackage travel to the workers with the job,
so executors need not have it installed."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
