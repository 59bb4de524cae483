"""Recommender-data engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from mediarec.session import build_session

# Task functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
