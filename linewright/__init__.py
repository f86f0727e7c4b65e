"""Spark-native building, auditing and scoring of line-transcription corpora."""

import sys

from pyspark import cloudpickle

from linewright.session import build_session, scratch_dir

# Functions of this package travel to the workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_dir"]
