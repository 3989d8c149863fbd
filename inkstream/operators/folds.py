"""Folds over a key's rows in order, where what a row does depends on all before it.

Rows are dealt by key and sorted within their partition; a task then lets them
pass and holds one key's state at a time, so a key of any number of rows costs
the memory of a batch.  Streams use the same steps with their state between
micro-batches (``streaming.stateful``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def folded(rows: DataFrame, key: str, order: list[str], values: list[str], begin: Callable[[], Any], step: Callable[[Any, tuple], list[tuple]], schema: str) -> DataFrame:
    """``key`` and the columns of ``schema``: what ``step(state, values)`` gives for each row, from a state that ``begin()`` makes for a key."""
    kind = rows.schema[key].dataType.simpleString()
    whole = f"`{key}` {kind}, {schema}"
    narrow = rows.select(key, *dict.fromkeys([*values, *order]))
    dealt = narrow.repartition(key).sortWithinPartitions(key, *order)
    shape = to_arrow_schema(_parse_datatype_string(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, started = None, None, False
        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, *values)]
            for k, *row in zip(*columns):
                if not started or k != own:
                    own, state, started = k, begin(), True
                out += [(k, *x) for x in step(state, tuple(row))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), shape)] if out else [pa.array([], type=f.type) for f in shape], schema=shape)

    return dealt.mapInArrow(run, whole)


class Throttle:
    """Passes progress on that exceeds what passed last, and is late enough after it, far enough above it, or complete."""

    def __init__(self, interval: float, jump: float, t: float = 0.0, v: float = -1.0):
        self.interval, self.jump, self.t, self.v = interval, jump, t, v

    def step(self, at: float, value: float) -> bool:
        if at is None or value is None or value <= self.v or not (at - self.t >= self.interval or value - self.v >= self.jump or value >= 1):
            return False
        self.t, self.v = at, value
        return True


class CacheEntry:
    """A key's last search that found something, until it expires; times in milliseconds."""

    def __init__(self, keep_ms: int, items: str | None = None, expires: int = 0):
        self.keep_ms, self.items, self.expires = keep_ms, items, expires

    def step(self, now: int, aspect: str | None, term: str | None, found: str | None) -> tuple[bool, str | None]:
        """Whether the entry answers, and the answer: items as JSON under the caller's term, null if the search failed."""
        hit = self.items is not None and self.expires > now and all(fits(aspect, x) for x in json.loads(self.items))
        if not hit and found is not None and json.loads(found):
            self.items, self.expires = found, now + self.keep_ms
        got = self.items if hit else found
        told = None if got is None else json.dumps([x | {"term": term} for x in json.loads(got)], ensure_ascii=False, separators=(",", ":"))
        return hit, told


def fits(aspect: str | None, item: dict) -> bool:
    """Whether an item's size suits an aspect; one of unknown size suits no aspect but a square."""
    w, h = item.get("width"), item.get("height")
    if aspect not in ("portrait", "landscape"):
        return True
    return w is not None and h is not None and (h > w if aspect == "portrait" else w > h)
