"""Parley: predictive retrieval over conversational data, on Spark DataFrames.

The package's functions travel to Python workers by value, so executors need
no copy of it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def worker_cache() -> dict:
    """What a Python worker keeps between tasks; it lives outside the package, as that travels by value."""
    return sys.__dict__.setdefault("_kept_between_tasks", {})
