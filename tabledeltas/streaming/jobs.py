"""Several streaming queries in one job."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

POLL_SECONDS = 1


def run_streams(starts: Sequence[Callable[[], StreamingQuery]]) -> list[StreamingQuery]:
    """Start all queries and wait until all have ended.

    If one fails, whichever it is, the others are stopped and its error is raised.
    """
    queries: list[StreamingQuery] = []
    try:
        for start in starts:
            queries.append(start())
        while active := [q for q in queries if q.isActive]:
            _raise_failure(queries)
            active[0].awaitTermination(POLL_SECONDS)
        _raise_failure(queries)
        return queries
    finally:
        for query in queries:
            if query.isActive:
                query.stop()


class _Idle(StreamingQueryListener):
    """Notes the queries that found nothing new after what they had read."""

    def __init__(self) -> None:
        self.queries: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.queries.discard(str(event.progress.id))

    def onQueryIdle(self, event) -> None:
        self.queries.add(str(event.id))

    def onQueryTerminated(self, event) -> None:
        pass


def run_until_idle(
    spark: SparkSession, starts: Sequence[Callable[[], StreamingQuery]]
) -> list[StreamingQuery]:
    """Like ``run_streams`` for queries that do not end by themselves, with the default trigger
    for instance: each is stopped once Spark reports that it waits for new data."""
    idle = _Idle()

    def watched(start: Callable[[], StreamingQuery]) -> Callable[[], StreamingQuery]:
        def begin() -> StreamingQuery:
            query = start()
            threading.Thread(target=stop_when_idle, args=(query,), daemon=True).start()
            return query

        return begin

    def stop_when_idle(query: StreamingQuery) -> None:
        while query.isActive and str(query.id) not in idle.queries:
            time.sleep(POLL_SECONDS / 10)
        query.stop()

    spark.streams.addListener(idle)
    try:
        return run_streams([watched(start) for start in starts])
    finally:
        spark.streams.removeListener(idle)


def _raise_failure(queries: Sequence[StreamingQuery]) -> None:
    for query in queries:
        error = query.exception()
        if error is not None:
            raise error
