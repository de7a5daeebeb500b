"""T001 on a stream of events: a running count per row set, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..deploy import ship
from ..functions.scalars import set_signature

EVENT = "session_id string, ordinal long, kind string, call_site string, class string, method string, input_rows array<struct<dataset_id:string,row_key:string>>"
OUT = "session_id string, signature string, ordinal long, evaluations long"


def repeated_evaluations(events: DataFrame) -> DataFrame:
    """Each score of a row set from its second on. Events of a row set come in order of their ordinals.

    Membership is not looked at here: join the result with it once the session is over.
    """
    ship(events.sparkSession)
    sig = set_signature(F.transform("input_rows", lambda r: F.concat(r["dataset_id"], F.lit(":"), r["row_key"])))
    scores = events.filter("kind = 'score'").select("session_id", sig.alias("signature"), "ordinal")

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = sorted(o for b in batches for o in b["ordinal"])
        out = [(key[0], key[1], o, n + k + 1) for k, o in enumerate(rows) if n + k + 1 >= 2]
        state.update((n + len(rows),))
        yield pd.DataFrame(out, columns=["session_id", "signature", "ordinal", "evaluations"])

    return scores.groupBy("session_id", "signature").applyInPandasWithState(count, OUT, "n long", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per window and kind; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "kind").agg(F.count("*").alias("n"))
