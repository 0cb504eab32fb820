"""Document retrieval and question answering as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .config import Settings

# Functions run by Python workers travel with their code, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Engine", "Settings"]


def __getattr__(name):
    if name == "Engine":
        from .plans.engine import Engine

        return Engine
    raise AttributeError(name)
