"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over windows of bytes, and the strongest answer of each
filter is kept in chunks that overlap and together cover the whole document. Over the chunks the
answers are combined by maximum and by mean, and a logistic unit turns them into one probability.
Fitting uses a bounded sample of labelled rows; scoring runs over whole texts on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a byte's embedding, bytes of a window, bytes between windows, filters.
EMBEDDED, WINDOW, STRIDE, FILTERS = 6, 8, 4, 32
#: Windows of a cell; cells of a chunk, the last of which the next chunk begins with.
CELL, CHUNK = 16, 9
_CELL_BYTES = CELL * STRIDE

#: Bound of the fitting sample: labelled rows (those with the smallest checksum of their id), and bytes of a text among them.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 1 << 16
EPOCHS, BATCH, RATE = 10, 32, 0.01
#: From this score on, a document counts as good.
THRESHOLD = 0.7
#: Rows whose checksum of the id leaves this remainder by FOLDS are held out.
FOLDS, HELD_OUT = 4, 2

#: Bytes scored at once.
AT_ONCE = 1 << 20


class QualityNet:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embedding = r.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
        self.embedding[0] = 0  # padding
        self.filters = r.normal(0, (WINDOW * EMBEDDED) ** -0.5, (WINDOW * EMBEDDED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]

    @staticmethod
    def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, each padded to whole cells; where each text's cells begin, and the end)."""
        cells = [max(1, -(-len(t) // _CELL_BYTES)) for t in texts]
        data = b"".join(t.ljust(n * _CELL_BYTES, b"\0") for t, n in zip(texts, cells))
        return np.frombuffer(data + b"\0" * (WINDOW - STRIDE), np.uint8), np.concatenate([[0], np.cumsum(cells)])

    def _answers(self, data: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Filters' answers at every window, before the cut at zero. A text's last window ends in padding."""
        answers, last = self._windows(data), cells[1:] * CELL - 1
        # Not the next text's first step.
        answers[last] = self.embedding[data.reshape(-1, STRIDE)[last]].reshape(len(last), -1) @ self.filters[: STRIDE * EMBEDDED] + self.bias
        return answers

    def _windows(self, data: np.ndarray) -> np.ndarray:
        """Filters' answers at every window of bytes that lie one after the other."""
        steps = self.embedding[data].reshape(-1, STRIDE * EMBEDDED)
        # A window is two steps: each step meets both halves of the filters in one product.
        halves = steps @ np.concatenate([self.filters[: STRIDE * EMBEDDED], self.filters[STRIDE * EMBEDDED :]], axis=1)
        return halves[:-1, :FILTERS] + halves[1:, FILTERS:] + self.bias

    @staticmethod
    def _chunks(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first and last cell of each chunk, chunks of each text): chunks step by all their cells but one."""
        spans, counts = [], []
        for start, stop in zip(cells.tolist(), cells[1:].tolist()):
            firsts = range(start, max(start + 1, stop - 1), CHUNK - 1)
            counts.append(len(firsts))
            spans += [(a, min(a + CHUNK, stop)) for a in firsts]
        return np.array(spans), np.array(counts)

    def _pooled(self, texts: list[bytes]):
        data, cells = self._laid_out(texts)
        answers = self._answers(data, cells)
        by_cell = answers.reshape(-1, CELL, FILTERS).max(axis=1)
        spans, counts = self._chunks(cells)
        ends = np.append(spans.ravel(), 0)[:-1]
        padded = np.concatenate([by_cell, by_cell[-1:]])
        by_chunk = np.maximum(np.maximum.reduceat(padded, ends, axis=0)[::2], 0)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        top = np.maximum.reduceat(by_chunk, first, axis=0)
        mean = np.add.reduceat(by_chunk, first, axis=0) / counts[:, None].astype(np.float32)
        return data, cells, answers, spans, counts, by_chunk, np.concatenate([top, mean], axis=1)

    def _long_features(self, text: bytes) -> np.ndarray:
        """As ``_pooled`` for one text of any length: some chunks at a time, of which the maxima and sums are carried on."""
        cells = max(1, -(-len(text) // _CELL_BYTES))
        chunks = len(range(0, max(1, cells - 1), CHUNK - 1))
        step = max(1, AT_ONCE // ((CHUNK - 1) * _CELL_BYTES))
        top, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS)
        for chunk in range(0, chunks, step):
            n = min(step, chunks - chunk)
            first = chunk * (CHUNK - 1)
            last = min(cells, first + (n - 1) * (CHUNK - 1) + CHUNK)
            # The step after the last window too; beyond the text it is padding, which answers nothing.
            part = text[first * _CELL_BYTES : last * _CELL_BYTES + WINDOW - STRIDE].ljust((last - first) * _CELL_BYTES + WINDOW - STRIDE, b"\0")
            answers = self._windows(np.frombuffer(part, np.uint8))
            by_cell = answers.reshape(-1, CELL, FILTERS).max(axis=1)
            for a in range(0, n * (CHUNK - 1), CHUNK - 1):
                own = np.maximum(by_cell[a : a + CHUNK].max(axis=0), 0)
                top, total = np.maximum(top, own), total + own
        return np.concatenate([top, (total / chunks).astype(np.float32)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        short = [t for t in texts if len(t) <= AT_ONCE]
        found = iter(self._pooled(short)[-1] if short else ())
        features = np.stack([next(found) if len(t) <= AT_ONCE else self._long_features(t) for t in texts])
        return 1 / (1 + np.exp(-(features @ self.out + self.out_bias[0]).astype(np.float64)))

    def _gradients(self, texts: list[bytes], wanted: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        data, cells, answers, spans, counts, by_chunk, features = self._pooled(texts)
        p = 1 / (1 + np.exp(-(features @ self.out + self.out_bias[0])))
        error = ((p - wanted) * weight / len(texts)).astype(np.float32)
        back = error[:, None] * self.out
        text_of = np.repeat(np.arange(len(texts)), counts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        top = np.maximum.reduceat(by_chunk, first, axis=0)
        # A maximum passes its share to the first chunk that reaches it, and a chunk to its strongest window.
        reaches = by_chunk == top[text_of]
        seen = np.cumsum(reaches, axis=0)
        before = (seen[first] - reaches[first])[text_of]
        leads = reaches & (seen - before == 1)
        share = back[text_of, FILTERS:] / counts[text_of, None] + leads * back[text_of, :FILTERS]
        share *= by_chunk > 0
        strongest = np.stack([a * CELL + answers[a * CELL : b * CELL].argmax(axis=0) for a, b in spans])
        rows, filters, g = strongest.ravel(), np.tile(np.arange(FILTERS), len(spans)), share.ravel()
        used = np.flatnonzero(g)
        rows, filters, g = rows[used], filters[used], g[used]
        letters = data[rows[:, None] * STRIDE + np.arange(WINDOW)]
        letters[np.isin(rows, cells[1:] * CELL - 1), STRIDE:] = 0
        inputs = self.embedding[letters].reshape(len(rows), -1)
        d_filters = np.zeros_like(self.filters)
        for k in range(FILTERS):
            own = filters == k
            d_filters[:, k] = g[own] @ inputs[own]
        d_letters = (g[:, None] * self.filters.T[filters]).reshape(-1, EMBEDDED)
        d_embedding = np.stack([np.bincount(letters.ravel(), d_letters[:, e], 256) for e in range(EMBEDDED)], axis=1).astype(np.float32)
        d_embedding[0] = 0
        d_bias = np.bincount(filters, g, FILTERS).astype(np.float32)
        return [d_embedding, d_filters, d_bias, error @ features, error.sum(keepdims=True)]

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 11) -> QualityNet:
        """Adam on the log loss; the rarer label weighs up to half as much again."""
        r, step = np.random.default_rng(seed), 0
        good = max(1, int(labels.sum()))
        factor = min(1.5, max(1.0, good / max(1, len(labels) - good)))
        weights = np.where(labels == 0, factor, 1.0)
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in self.parameters()]
        for epoch in range(EPOCHS):
            order = r.permutation(len(texts))
            rate = RATE * (1 - epoch / EPOCHS)
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                step += 1
                for x, (m, v), g in zip(self.parameters(), moments, self._gradients([texts[k] for k in some], labels[some], weights[some])):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % FOLDS


def fit_on_labels(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> QualityNet:
    """Fits on at most ``rows`` labelled documents that are not held out, of at most SAMPLE_BYTES each.

    The sample is fixed by the ids' checksums; of documents with one id that with the smallest text is taken, of its labels the
    smallest. Rows without id or label are left out; without any labelled row the net stays as it is made.
    """
    known = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    chosen = known.where(fold("k") != HELD_OUT).groupBy("k").agg(F.min("y").alias("y")).orderBy(F.crc32(F.col("k").cast("string")), "k").limit(rows)
    own = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES)
    # At most ``rows`` keys, and one text of bounded length for each.
    sample = sorted(own.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t")).collect())
    net = QualityNet()
    return net.fit([r["t"].encode() for r in sample], np.array([r["y"] for r in sample], float)) if sample else net


def _scored(batches: Iterable[pa.RecordBatch], column: int, net: QualityNet) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows in slices of about AT_ONCE bytes of text, with their scores."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        group, size, at = [], 0, 0
        for k in range(batch.num_rows):
            group.append(texts[k].as_py() or b"")
            size += len(group[-1])
            if size >= AT_ONCE or k == batch.num_rows - 1:
                yield batch.slice(at, len(group)), net.scores(group)
                at, group, size = k + 1, [], 0


def score(docs: DataFrame, net: QualityNet, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from the whole text.

    Null and empty texts get the net's answer to nothing. Rows with the same key each get a row.
    A null key is never held out.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found in _scored(batches, 1, net):
            held = [x is not None and zlib.crc32(str(x).encode()) % FOLDS == HELD_OUT for x in some.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(held), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def kept_documents(docs: DataFrame, net: QualityNet, text: str = "text") -> DataFrame:
    """The rows that score THRESHOLD or more, with their columns as they are."""
    column = docs.columns.index(text)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found in _scored(batches, column, net):
            yield some.filter(pa.array(found >= THRESHOLD))

    return docs.mapInArrow(rows, docs.schema)
