"""Validation of ledger rows as they arrive: keyed state instead of windows.

State per stream is the last balance, the last date and the direction of dates, so a stream of any length
costs a few bytes. Rows are taken in arrival order inside a trigger, sorted by (page, row, candidate_id);
a row that arrives in a later trigger than its successors is compared with the state of that time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "stream string, page_index int, row_index int, candidate_id bigint, code string"
STATE = "balance string, day int, direction int"


def _check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    from decimal import Decimal

    balance, day, direction = state.get if state.exists else (None, None, 0)
    balance = None if balance is None else Decimal(balance)
    rows = pd.concat(list(batches)).sort_values(["page_index", "row_index", "candidate_id"], kind="stable")
    found = []
    for r in rows.itertuples():
        amount = None if pd.isna(r.amount) else Decimal(r.amount)
        now = None if pd.isna(r.balance) else Decimal(r.balance)
        if balance is not None and amount is not None and now is not None and balance + amount != now:
            found += [(key[0], r.page_index, r.row_index, r.candidate_id, c) for c in ("balance_mismatch", "possible_missing_transaction")]
        balance = now
        if not pd.isna(r.day):
            turn = 0 if day is None else (r.day > day) - (r.day < day)
            if turn and direction and turn != direction:
                found.append((key[0], r.page_index, r.row_index, r.candidate_id, "date_order"))
            direction = direction or turn
            day = int(r.day)
    state.update((None if balance is None else str(balance), day, direction))
    yield pd.DataFrame(found, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def validate_stream(rows: DataFrame) -> DataFrame:
    """Continuity and date-order issues of a streaming DataFrame (M19): stream, page_index, row_index, candidate_id, code.

    rows hold stream, page_index, row_index, candidate_id, amount and balance as decimal text, and day as days since 1970.
    """
    return rows.groupBy("stream").applyInPandasWithState(_check, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(rows: DataFrame, name: str, checkpoint: str | None = None) -> None:
    """Drive a streaming DataFrame over all available input into an in-memory table, for tests and small reports."""
    writer = rows.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
