"""Derived inputs built once per session and table folder.

Some queries read data that Spark first derives from the tables and writes
out: step-log text files, a feature cache, the corpus vocabulary.  In a
pipeline these are artifacts produced once and read by many jobs; here they
are built on first use and shared by the queries of the same session that
read the same table folder.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_MEMO: dict[tuple[str, str, str], Any] = {}


def shared(spark, sf: str, name: str, build: Callable[[], Any]) -> Any:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]
