"""Connected components, with copies made as this subpackage makes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions import components
from ._common import durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, copy: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    return components.connected_components(edges, a, b, max_rounds, copy)
