"""Work that may fail, tried again a bounded number of times across restarts.

What happened is a stream of events: a key is new, or an attempt at it passed or failed.  A
stateful operator keeps, for each key, how many attempts were asked for, the batch of the last
one, and whether the key is done, in the query's checkpoint.  Each pass over new events says
which keys to try; the outcomes of the work are new events for the next pass.

An event of an attempt that was handled already changes nothing, so a batch that is run twice
after a failure asks for the same attempts and counts none of them twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.streaming.incremental import has_data

#: An event: attempt 0 and null for a new key, else which attempt passed or not.
EVENTS = "key string, attempt int, passed boolean"
MOST = 3
_DECISIONS = "key string, attempt int, action string"


def announce(keys: DataFrame, key: str, events: str) -> None:
    """New keys as events; keys that are known already may be announced again."""
    keys.select(F.col(key).cast("string").alias("key"), F.lit(0).alias("attempt"), F.lit(None).cast("boolean").alias("passed")).write.mode("append").parquet(events)


def decide(most: int) -> Callable:
    """The state function: (attempt, action) for a key and its new events."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked, done = state.get if state.exists else (0, False)
        before, was_done = asked, done
        outcomes: dict[int, bool] = {}
        for frame in frames:
            for attempt, passed in zip(frame["attempt"], frame["passed"], strict=True):
                if pd.notna(passed):
                    outcomes[int(attempt)] = outcomes.get(int(attempt), False) or bool(passed)
        if not done and any(outcomes.values()):
            done = True
        elif not done and asked == 0 or not done and outcomes.get(asked) is False and asked < most:
            asked += 1
        elif not done and outcomes.get(asked) is False:
            done = True
        state.update((asked, done))
        if asked > before:
            yield pd.DataFrame({"key": [key[0]], "attempt": [asked], "action": ["try"]})
        elif done and not was_done:
            yield pd.DataFrame({"key": [key[0]], "attempt": [asked], "action": ["passed" if any(outcomes.values()) else "given_up"]})

    return update


def one_pass(spark: SparkSession, events: str, decisions: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], most: int = MOST) -> None:
    """Reads new events, decides, works on what is to be tried, and appends the outcomes as events.

    ``work`` takes (key, attempt) and returns (key, attempt, passed).  Decisions are appended to
    ``decisions`` by batch; those of a batch that is repeated replace their first copy.
    """

    def batch(rows: DataFrame, number: int) -> None:
        place = f"{decisions}/batch-{number}"
        rows.write.mode("overwrite").parquet(place)
        made = spark.read.schema(_DECISIONS).parquet(place)
        work(made.filter("action = 'try'").select("key", "attempt")).select("key", F.col("attempt").cast("int").alias("attempt"), "passed").write.mode("append").parquet(events)

    stream = spark.readStream.schema(EVENTS).parquet(events)
    decided = stream.groupBy("key").applyInPandasWithState(decide(most), _DECISIONS, "asked int, done boolean", "append", GroupStateTimeout.NoTimeout)
    decided.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def converge(spark: SparkSession, events: str, decisions: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], most: int = MOST) -> DataFrame:
    """Passes until no key is left to be tried; (key, attempt, action) of each key's end."""
    for _ in range(most + 1):
        one_pass(spark, events, decisions, checkpoint, work, most)
    return ends(spark, decisions)


def ends(spark: SparkSession, decisions: str) -> DataFrame:
    """The last decision of each key."""
    if not has_data(spark, decisions):
        return spark.createDataFrame([], _DECISIONS)
    made = spark.read.option("recursiveFileLookup", True).parquet(decisions)
    last = F.max(F.struct("attempt", (F.col("action") != "try").alias("end"), "action")).alias("x")
    return made.groupBy("key").agg(last).select("key", "x.attempt", "x.action")
