"""Training by local steps: rows in a set order are dealt to groups of a fixed size, groups to rounds of a fixed number.

In a round each group is one task that goes on from the common state by many small steps over its rows; the
driver then averages the groups' states, in the order of the groups. The number of steps grows with the rows, a task
holds one group's rows, and the driver as many states as a round has groups. Order, groups and rounds follow
from ids and seed alone, so a repeated run gives the same numbers whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget, materialize
from .ordering import draw, numbered

#: Rows of a group, and groups that train side by side.
GROUP_ROWS, PARALLEL = 65_536, 64


@dataclass
class Dealt:
    rows: DataFrame  # the columns trained on, with round, group and place
    rounds: int

    def drop(self) -> None:
        forget(self.rows)

    def round(self, r: int, work: Callable[[int, pd.DataFrame], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
        """What ``work(group, rows in order)`` gives for each group of a round, in the order of the groups."""

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            got = work(int(key[0]), pdf.sort_values("_at", ignore_index=True))
            return pd.DataFrame({"group": [key[0]], "sizes": [[x.size for x in got]], "values": [np.concatenate([np.ravel(x) for x in got])]})

        found = self.rows.where(F.col("_round") == r).drop("_round").groupBy("_group").applyInPandas(run, "group long, sizes array<int>, values array<double>")
        for row in sorted(found.collect(), key=lambda x: x["group"]):
            yield np.split(np.array(row["values"]), np.cumsum(row["sizes"])[:-1])


def deal(rows: DataFrame, columns: list[str], key: str = "id", seed: int = 0, group_rows: int = GROUP_ROWS, parallel: int = PARALLEL) -> Dealt:
    """``rows`` in md5(seed-key) order, every ``group_rows`` a group and every ``parallel`` groups a round, written by round."""
    drawn = numbered(rows.select(*columns, F.col(key).alias("_key"), draw(seed, key).alias("_draw")), ["_draw", "_key"], "_at")
    group = F.floor(F.col("_at") / group_rows)
    dealt = materialize(drawn.select(*columns, "_at", group.alias("_group"), F.floor(group / parallel).cast("int").alias("_round")), "dealt", "_round")
    last = dealt.agg(F.max("_round")).first()[0]
    return Dealt(dealt, 0 if last is None else last + 1)
