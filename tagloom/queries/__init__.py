"""Registered queries over the test tables, each next to its SQL twin."""

from pyspark import cloudpickle

import tagloom
from tagloom.queries import corpus, evaluation, inputs, jobs, records, runs, text
from tagloom.queries.registry import oracles, registered

# Workers may not have the package on their path, so its code is sent along.
cloudpickle.register_pickle_by_value(tagloom)

__all__ = [
    "corpus", "evaluation", "inputs", "jobs", "oracles", "records", "registered", "runs", "text",
]
