"""The registered queries, by section of the inventory."""

from labelloom.workload import base
from labelloom.workload import aggregates, boards, features, inference, models, sampling, scalars, sources  # noqa: F401


def all_queries():
    return dict(base.QUERIES)


def all_oracles():
    return dict(base.ORACLES)
