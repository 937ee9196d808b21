"""All registered queries, in the order of their modules."""

from __future__ import annotations

from tapewright.plans import bars, book, micro, models, reports, rules, store, streams, tape  # noqa: F401
from tapewright.plans.registry import QUERIES, Query


def registered() -> dict[str, Query]:
    return QUERIES
