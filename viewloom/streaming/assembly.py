"""Shards put together from a stream of records, written when whole.

Records of a shard arrive in any order, over any number of micro-batches, and some twice. What has come of a shard is
its state; when as many distinct records are there as the shard has, they leave together and the state keeps no more than
that mark. A shard to which nothing has come for a while leaves with what it has if that is most of it, and is dropped otherwise.

Defined results: a record that comes again replaces the earlier one until its shard has left, and is then ignored; null ids
are a record of their own; a shard of size 0 or less never leaves; empty batches change nothing. A shard's state is as large as its records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Share of a shard's records with which it may leave after a timeout.
ENOUGH = 0.99


def whole_shards(records: DataFrame, wait: str | None = None, enough: float = ENOUGH) -> DataFrame:
    """(shard_name, id, payload, n, shard_size) of the shards that have become whole, from a stream (shard_name, shard_size, id, payload).

    ``wait`` (such as "1 hour") is how long a shard may be silent before it leaves with at least ``enough`` of its records.
    It needs a trigger that goes on: a run that ends with its input takes none, since Spark would wait for the timers.
    """
    milliseconds = None
    if wait:
        amount, unit = wait.split()
        milliseconds = int(float(amount) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])

    def rows(shard: str, ids: list, payloads: list, size: int) -> pd.DataFrame:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or ""))
        return pd.DataFrame({"shard_name": shard, "id": [ids[i] for i in order], "payload": [payloads[i] for i in order], "n": len(ids), "shard_size": size})

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, size, ids, payloads = state.get if state.exists else (False, 0, [], [])
        if state.hasTimedOut:
            if not left and size > 0 and len(ids) >= round(size * enough):
                yield rows(key[0], list(ids), list(payloads), size)
            state.remove()
            return
        have = dict(zip(ids, payloads, strict=True))
        for b in batches:
            if not left:
                for i, payload, n in zip(b["id"], b["payload"], b["shard_size"], strict=True):
                    have[None if pd.isna(i) else i] = payload
                    size = int(n)
        if not left and 0 < size <= len(have):
            yield rows(key[0], list(have), list(have.values()), size)
            left, have = True, {}
        state.update((left, size, list(have), list(have.values())))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)

    return records.groupBy("shard_name").applyInPandasWithState(
        update, "shard_name string, id string, payload string, n int, shard_size int", "left boolean, size int, ids array<string>, payloads array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout,
    )
