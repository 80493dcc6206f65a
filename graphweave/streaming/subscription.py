"""Subscriptions: the root is a stream, the other sources are joined to it as they are.

A subscription lowers like a query in flat shape. Its root's binding gives a streaming frame; every
join below has the stream on its left and a static table on its right, so it runs in append mode
without state, row by row as events arrive.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from graphweave.errors import GraphError
from graphweave.gateway import Gateway


def subscribe(gateway: Gateway, query: str, variables: dict[str, Any] | None = None, operation_name: str | None = None) -> DataFrame:
    """The streaming frame of a subscription's only root."""
    response = gateway.execute(query, variables, operation_name)
    if response.data is None:
        raise GraphError("; ".join(r.message for r in response.error_rows))
    if response.plan.kind != "subscription" or len(response.data) != 1:
        raise GraphError("a subscription with one root field is needed")
    frame = next(iter(response.data.values()))
    if not frame.isStreaming:
        raise GraphError("the root's rows are not a stream")
    return frame
