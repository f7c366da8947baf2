"""All registered queries, by area."""

from filingloom.plans.catalog.base import ORACLES, QUERIES
from filingloom.plans.catalog import (  # noqa: F401, E402
    auditing,
    comparing,
    evaluation,
    extraction,
    jobs,
    labelling,
    manifests,
    serving,
)

__all__ = ["ORACLES", "QUERIES"]
