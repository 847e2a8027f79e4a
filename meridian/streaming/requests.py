"""Streams of requests and answers: the latest wins, stale answers go, bursts count once, starts keep a distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds of quiet after which a query counts, letters of the shortest one, seconds between requests.
QUIET_MS, LETTERS, PACE_S = 800, 3, 1.2


def latest(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Of each key the row of the greatest number; a partial aggregate."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), number).alias("__row")).select(key, "__row.*").select(*rows.columns)


def latest_of_batch(work: Callable[[DataFrame, int], None], key: str, number: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: only the latest request of each key in a batch is worked on."""
    return lambda batch, epoch: work(latest(batch, key, number), epoch)


def current_answers(answers: DataFrame, key: str, number: str) -> DataFrame:
    """A stream of answers without those older than one that has come for their key before; the greatest number is kept as state."""
    schema = answers.schema
    names = schema.names
    at = names.index(number)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        for frame in frames:
            kept = []
            for row in frame[names].itertuples(index=False, name=None):
                if best is None or row[at] >= best:
                    best = int(row[at])
                    kept.append(row)
            yield pd.DataFrame(kept, columns=names)
        if best is not None:
            state.update((best,))

    return answers.groupBy(key).applyInPandasWithState(step, schema, "best long", "append", GroupStateTimeout.NoTimeout)


def settled_queries(queries: DataFrame, user: str, time: str, text: str, late: str, quiet_ms: int = QUIET_MS, letters: int = LETTERS) -> DataFrame:
    """The last query of each burst: one is a session whose queries come within ``quiet_ms`` of one another. Short ones count for none."""
    rows = queries.withWatermark(time, late) if queries.isStreaming else queries
    bursts = rows.groupBy(user, F.session_window(time, f"{quiet_ms} milliseconds").alias("w")).agg(F.max_by(F.trim(text), time).alias(text), F.max(time).alias("last"))
    return bursts.where(F.length(text) >= letters).select(user, F.col("last").alias(time), text)


def paced(times: Column, seconds: float = PACE_S) -> Column:
    """Array of the seconds at which requests come -> when each starts, at least ``seconds`` after the one before."""
    none = F.array().cast("array<double>")
    return F.aggregate(times, none, lambda done, t: F.array_append(done, F.greatest(t, F.coalesce(F.try_element_at(done, F.lit(-1)) + seconds, t))))


def generations(tokens: DataFrame, key: str, number: str, token: str) -> DataFrame:
    """``generation``: how many times the token of a key has changed up to a row; null tokens change nothing."""
    order = Window.partitionBy(key).orderBy(number)
    before = F.last(token, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    changed = F.col(token).isNotNull() & (before.isNull() | (F.col(token) != before))
    return tokens.withColumn("generation", F.sum(changed.cast("int")).over(order))
