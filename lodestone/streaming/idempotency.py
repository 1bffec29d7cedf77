"""Requests with a key that may come again: claimed once, answered again from what is stored, reclaimed when their owner died.

requests: key, ts, kind (request or complete), fingerprint of what was asked, response. A key's record is open from its claim until
it is completed, and is dropped `ttl` after its claim. Outcomes:

  claimed     no record (or one past its time): the request runs
  replayed    completed with the same fingerprint: the stored response is given again
  mismatch    the record has another fingerprint
  in_flight   open, and younger than `stale`
  reclaimed   open, but its owner has not completed it within `stale`: this request runs and the clock starts anew
  completed   an open record gets its response
  ignored     a completion without an open record
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, DONE = 0, 1
OUTCOME = "key string, id long, outcome string, response string"
STATE = "state int, fingerprint string, since long, until long, response string"


def step(record: tuple | None, kind: str, at: int, fingerprint: str | None, response: str | None, ttl: int, stale: int) -> tuple[tuple | None, str, str | None]:
    """The record after one row, the outcome and the response given. Times are in milliseconds."""
    if record and record[3] <= at:
        record = None
    if kind == "complete":
        if not record or record[0] != OPEN:
            return record, "ignored", None
        return (DONE, *record[1:4], response), "completed", response
    fresh = (OPEN, fingerprint, at, at + ttl, None)
    if not record:
        return fresh, "claimed", None
    if record[0] == OPEN and record[2] < at - stale:
        return fresh, "reclaimed", None
    if record[1] != fingerprint:
        return record, "mismatch", None
    return (record, "replayed", record[4]) if record[0] == DONE else (record, "in_flight", None)


def outcomes(requests: DataFrame, ttl: str = "24 hours", stale: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, id, outcome, response) of a stream of requests (id, key, ts, kind, fingerprint, response), each key's in order of time and
    id within a batch. A record leaves the state when the watermark has passed its end."""
    life, dead = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (ttl, stale))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        record = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out = []
        for i, at, kind, fingerprint, response in rows[["id", "at", "kind", "fingerprint", "response"]].itertuples(index=False):
            record, outcome, given = step(record, kind, at, fingerprint, response, life, dead)
            out.append((key[0], i, outcome, given))
        if record:
            state.update(record)
            state.setTimeoutTimestamp(max(record[3], state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "id", "outcome", "response"])

    rows = requests.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("key").applyInPandasWithState(run, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)
