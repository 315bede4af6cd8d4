"""Asking a model from within a job: any callable from sentence to answer, with retries.

The callable is made once per task by a factory (so that a client or a model is loaded there), and
errors become rows. There is no client for a particular service here; tests and offline runs replay
answers.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

#: Response codes after which asking again may help.
RETRYABLE = frozenset({408, 409, 429, 500, 502, 503, 504})


#: Rows that are asked together, for each request in flight: a slow answer holds up no more.
WINDOW = 32


class ServiceError(Exception):
    """retry_after: seconds that the service asked to wait, if it did."""

    def __init__(self, code: int, message: str = "", retry_after: float | None = None):
        super().__init__(f"{code} {message}".strip())
        self.code, self.retry_after = code, retry_after


def delays(attempts: int, base: float, seed: str) -> Iterator[float]:
    """Seconds to wait after each failed attempt: doubling, with jitter fixed by the seed."""
    r = random.Random(seed)
    for k in range(attempts - 1):
        yield base * 2**k * (1 + r.random() / 2)


class TokenBucket:
    """At most ``rate`` requests a second on average, and ``burst`` at once; shared by the threads of a task."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep):
        self._rate, self._burst, self._clock, self._wait = rate, burst, clock, wait
        self._tokens, self._at, self._lock = float(burst), clock(), threading.Lock()

    def take(self) -> None:
        with self._lock:
            now = self._clock()
            self._tokens = min(self._burst, self._tokens + (now - self._at) * self._rate) - 1
            self._at = now
            pause = -self._tokens / self._rate
        if pause > 0:
            self._wait(pause)


def asked(tasks: DataFrame, factory: Callable[[], Callable[[str], str]], text: str = "source_text", attempts: int = 4, base: float = 1.0, wait: Callable[[float], None] = time.sleep, in_flight: int = 1, rate: float | None = None, burst: int = 1) -> DataFrame:
    """Adds ``raw_model_output`` and ``request_error`` to tasks; null text is not asked.

    Each Spark task has up to ``in_flight`` requests under way, made by threads (the callable must allow that if it is over
    1), and gives answers back in the order of its rows; memory is bounded by the answers of WINDOW times as many rows.
    rate: requests a second of each Spark task, with ``burst`` at once. A failed request is repeated after the
    pause that the service asks for, or doubling ones, if its code is retryable.
    """
    names, at = tasks.columns, tasks.columns.index(text)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = factory()
        bucket = TokenBucket(rate, burst, wait=wait) if rate else None

        def one(sentence: str | None) -> tuple[str | None, str | None]:
            if sentence is None:
                return None, "no text"
            pauses = delays(attempts, base, sentence)
            while True:
                if bucket:
                    bucket.take()
                try:
                    return ask(sentence), None
                except ServiceError as e:
                    pause = next(pauses, None) if e.code in RETRYABLE else None
                    if pause is None:
                        return None, str(e)
                    wait(pause if e.retry_after is None else e.retry_after)

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for low in range(0, batch.num_rows, WINDOW * in_flight):
                    some = batch.slice(low, WINDOW * in_flight)
                    sentences = some.column(at).to_pylist()
                    found = list(pool.map(one, sentences)) if in_flight > 1 else [one(t) for t in sentences]
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([a for a, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], [*names, "raw_model_output", "request_error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema)
    return tasks.mapInArrow(rows, f"{schema}, raw_model_output string, request_error string")
