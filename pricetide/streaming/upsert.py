"""Change capture as a stream: one state for each listing, a row out for each change.

The same rules as `operators.history`: an observation older than what its listing has
seen is dropped (per listing, whatever the watermark), and a history row is written when
price or stock changes. Within a micro-batch a listing's rows are taken in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "retailer_id bigint, listing string, arrival bigint, seen_at timestamp, price_bani bigint, in_stock boolean, outcome string"
STATE = "seen_at timestamp, price_bani bigint, in_stock boolean"


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else None
    out = []
    rows = pd.concat(list(parts)).sort_values(["arrival", "seen_at", "price_bani"], kind="stable")
    for arrival, seen, price, stock in zip(rows["arrival"], rows["seen_at"], rows["price_bani"], rows["in_stock"]):
        if held is not None and seen < held[0]:
            continue
        if held is None or (price, stock) != (held[1], held[2]):
            out.append((*key, arrival, seen, price, stock, "created" if held is None else "changed"))
        held = (seen, price, stock)
    if held is not None:
        state.update(held)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def changes(observations: DataFrame) -> DataFrame:
    """A stream of observations (retailer_id, listing, arrival, seen_at, price_bani, in_stock) to a stream of changes."""
    rows = observations.selectExpr("retailer_id", "cast(listing as string) as listing", "arrival", "seen_at", "price_bani", "in_stock")
    return rows.groupBy("retailer_id", "listing").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def append_history(changes_: DataFrame, path: str, checkpoint: str):
    """Starts the stream into Parquet files; each micro-batch is added once."""
    return changes_.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
