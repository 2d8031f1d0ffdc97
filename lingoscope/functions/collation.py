"""Orders in which people look names up, apart from the code order that keys and groups keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collated(name: Column | str) -> list[Column]:
    """Sort columns: by the Unicode root collation (a before A before b), what it can't tell apart by code points."""
    return [F.collate(name, "UNICODE"), F.col(name) if isinstance(name, str) else name]
