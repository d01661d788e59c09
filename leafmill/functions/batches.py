"""Functions over Arrow batches that can be declared before a session exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def on_batches(kind: str) -> Callable:
    """Makes a function of a pandas Series a column function of type ``kind``."""

    def declare(f: Callable) -> Callable[..., Column]:
        return lambda *columns: F.pandas_udf(f, kind)(*columns)

    return declare
