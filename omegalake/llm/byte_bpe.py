"""Byte-level BPE: vectorised pre-tokenisation by transition-function scans, then cached merging.

Each character gets a class (letter, number, other mark, white space inside or at the end of
a run, apostrophe of a contraction). A class is a function from the scanner's states to its
states; such functions compose associatively, so the states at all positions of a batch of
texts come from a scan over blocks: compose within blocks, run over the blocks' functions,
and fill in. A table says in which state a class begins a new piece.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters scanned at once, and characters of a block.
BATCH_CHARS = 1 << 20
BLOCK = 256
#: Remembered pieces of a worker; on overflow the memory starts anew.
MEMORY = 1 << 20
#: Pieces of more bytes are merged with a heap.
LONG_PIECE = 128

#: What may follow an apostrophe as a piece of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# Classes of characters; END stands between texts.
INNER, LAST_SPACE, LAST_OTHER, LETTER, NUMBER, MARK, SHORT, LONG, END = range(9)
# States of the scanner after a character.
FRESH, IN_LETTERS, IN_NUMBERS, IN_MARKS, IN_SPACE, JOINED, ONE_MORE, TWO_MORE = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by class and state."""
    after, begins = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    for c in range(9):
        for s in range(8):
            runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, MARK: IN_MARKS}
            if c == END:
                after[c, s], begins[c, s] = FRESH, True
            elif s in (ONE_MORE, TWO_MORE):
                after[c, s] = ONE_MORE if s == TWO_MORE else FRESH
            elif c == INNER:
                after[c, s], begins[c, s] = IN_SPACE, s != IN_SPACE
            elif c == LAST_SPACE:
                after[c, s], begins[c, s] = JOINED, True
            elif c == LAST_OTHER:
                after[c, s], begins[c, s] = FRESH, True
            elif c in runs:
                after[c, s], begins[c, s] = runs[c], s not in (runs[c], JOINED)
            elif s in (IN_MARKS, JOINED):
                after[c, s] = IN_MARKS
            else:
                after[c, s], begins[c, s] = (ONE_MORE if c == SHORT else TWO_MORE), True
    return after, begins


_AFTER, _BEGINS = _tables()
_kinds: list[np.ndarray] = []


def _kind_of_codepoints() -> np.ndarray:
    """LETTER, NUMBER, MARK or INNER (white space) of every code point.

    Unicode grows, and the library has its own edition of it: it is asked once for the code points of each class,
    by an encoding that keeps every match as bytes.
    """
    if not _kinds:
        import tiktoken

        codes = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, sys.maxunicode + 1, dtype="<u4")])
        everything = codes.tobytes().decode("utf-32-le")
        as_bytes = {bytes([b]): b for b in range(256)}
        kind = np.full(sys.maxunicode + 2, MARK, np.uint8)
        for pattern, own in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", INNER)):
            library = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=as_bytes, special_tokens={})
            matched = bytes(library.encode_ordinary(everything)).decode()
            kind[np.frombuffer(matched.encode("utf-32-le"), "<u4")] = own
        kind[-1] = END
        _kinds.append(kind)
    return _kinds[0]


def _classes(codes: np.ndarray) -> np.ndarray:
    """codes: code points of texts, each text followed by the end mark ``sys.maxunicode + 1``."""
    kind = _kind_of_codepoints()[codes]
    following = np.append(kind[1:], END)
    last = (kind == INNER) & (following != INNER) & (following != END)
    kind[last] = np.where(codes[last] == 0x20, LAST_SPACE, LAST_OTHER)
    padded = np.concatenate([codes, [0, 0]])
    at = np.flatnonzero(codes == ord("'"))
    one, two = padded[at + 1], padded[at + 2]
    for c in CONTRACTIONS:
        hit = (one == ord(c[0])) & ((len(c) == 1) | (two == ord(c[-1])))
        kind[at[hit]] = SHORT if len(c) == 1 else LONG
    return kind


def _states(classes: np.ndarray, start: int = FRESH) -> np.ndarray:
    """The state before every character."""
    blocks = -(-len(classes) // BLOCK)
    padded = np.full(blocks * BLOCK, END, np.uint8)
    padded[: len(classes)] = classes
    # Transposed: one step reads the same place of every block.
    grid = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    flat = _AFTER.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))  # each block's composed function
    for row in grid:
        whole = flat[(row.astype(np.uint16) * 8)[:, None] + whole]
    at = np.empty(blocks, np.uint8)  # states at the blocks' starts
    state = start
    for k, f in enumerate(whole.tolist()):
        at[k] = state
        state = f[state]
    before = np.empty_like(grid)
    for k, row in enumerate(grid):
        before[k] = at
        at = flat[row.astype(np.uint16) * 8 + at]
    return before.T.ravel()[: len(classes)]


def slices_of(text: str, chars: int = BATCH_CHARS) -> Iterator[list[bytes]]:
    """The pieces of one text, however long, slice by slice: the scanner's state is carried on, and two characters are seen ahead."""
    state, held = FRESH, b""
    for at in range(0, len(text), chars):
        part = text[at : at + chars]
        codes = np.frombuffer(text[at : at + chars + 2].encode("utf-32-le"), "<u4")
        classes = _classes(np.append(codes, np.uint32(sys.maxunicode + 1)))[: len(part)]
        states = _states(classes, state)
        state = int(_AFTER[classes[-1], states[-1]])
        codes, data = codes[: len(part)], part.encode()
        width = (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000) + 1
        place = np.cumsum(width) - width
        begins = place[np.flatnonzero(_BEGINS[classes, states])].tolist()
        if not begins:
            held += data
            continue
        yield [p for p in (held + data[: begins[0]], *(data[a:b] for a, b in zip(begins, begins[1:]))) if p]
        held = data[begins[-1] :]
    if held:
        yield [held]


def pieces_of(texts: list[str]) -> list[list[bytes]]:
    """Each text's pieces in UTF-8, in order."""
    codes = np.concatenate([np.append(np.frombuffer(t.encode("utf-32-le"), "<u4"), np.uint32(sys.maxunicode + 1)) for t in texts])
    classes = _classes(codes)
    begins = np.flatnonzero(_BEGINS[classes, _states(classes)])
    width = (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000) + 1
    ends = classes == END
    width[ends] = 0
    place = np.concatenate([[0], np.cumsum(width)])
    data = "".join(texts).encode()
    marks = ends[begins]
    offsets = place[begins].tolist()
    found, first = [], 0
    for stop in np.flatnonzero(marks).tolist():
        own = offsets[first : stop + 1]
        found.append([data[a:b] for a, b in zip(own, own[1:])])
        first = stop + 1
    return found


class ByteBpe:
    """Ids by ranks, as the rank file gives them: the lowest-ranked adjacent pair merges first, leftmost of equals."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        own = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            own[rank] = token
        self._pool = np.frombuffer(b"".join(own), np.uint8)
        self._lengths = np.array([len(x) for x in own], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._known: dict[bytes, bytes] = {}

    def _merged(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > LONG_PIECE:
            return self._merged_by_heap(piece)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            k = pairs.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], 1 << 30)
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], 1 << 30)
        return [ranks[p] for p in parts]

    def _merged_by_heap(self, piece: bytes) -> list[int]:
        """The same in n log n steps: ends[k] is where the part that starts at k ends, or -1."""
        ranks, n = self.ranks, len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            middle = ends[k]
            if middle < 0 or middle >= n or ends[middle] != stop or stop <= middle:
                continue
            ends[k], ends[middle] = stop, -1
            if stop < n:
                before[stop] = k
                if (r := ranks.get(piece[k : ends[stop]])) is not None:
                    heapq.heappush(heap, (r, k, ends[stop]))
            if (p := before[k]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[k:e]] for k, e in enumerate(ends) if e > 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers. A text of over BATCH_CHARS characters is taken slice by slice."""
        gc.disable()  # no cycles are made here
        try:
            short = [t for t in texts if len(t) <= BATCH_CHARS]
            found = iter(self._ids_of(pieces_of(short)) if short else [])
            return [next(found) if len(t) <= BATCH_CHARS else b"".join(self._ids_of([own])[0] for own in slices_of(t)) for t in texts]
        finally:
            gc.enable()

    def _ids_of(self, split: list[list[bytes]]) -> list[bytes]:
        wanted: set[bytes] = set()
        wanted.update(*split)
        if len(self._known) + len(wanted) > MEMORY:
            self._known = {}
        known, merged = self._known, self._merged
        for piece in wanted:
            if piece not in known:
                known[piece] = np.array(merged(piece), "<u4").tobytes()
        get = known.__getitem__
        return [b"".join(map(get, own)) for own in split]

    def decode(self, ids: bytes, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of each id, put where its offset says; without offsets, one after the other."""
        found = np.frombuffer(ids, "<u4")
        offsets = self.offsets(ids) if offsets is None else offsets
        text = np.empty(int(offsets[-1]), np.uint8)
        for at in range(0, len(found), BATCH_CHARS):
            some = found[at : at + BATCH_CHARS]
            lengths = self._lengths[some]
            within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            text[np.repeat(offsets[at : at + len(some)], lengths) + within] = self._pool[np.repeat(self._starts[some], lengths) + within]
        return text.tobytes()

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where each id's bytes start in the text, and the text's length in bytes at last."""
        return np.concatenate([[0], np.cumsum(self._lengths[np.frombuffer(ids, "<u4")])])


_loaded: dict[str, ByteBpe] = {}


def vocabulary(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    group, chars = [], 0
    for t in texts.to_pylist():
        group.append(t)
        chars += len(t) + 1
        if chars >= BATCH_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary, offsets array<long>) of every whole text; null text is empty (no ids, offsets [0])."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1)):
                ids = bpe.encode(group)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(ids, pa.binary()), pa.array([bpe.offsets(x).tolist() for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])
                at += len(group)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(rows, "doc_id long, ids binary, offsets array<long>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text binary) from (doc_id, ids): the bytes that were encoded."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text binary")


def digests(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes) of every whole text.

    The offsets are kept with the ids, which are decoded again by them in the same task. n_bytes: where the last offset ends.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1)):
                ids = bpe.encode(group)
                offsets = [bpe.offsets(x) for x in ids]
                columns = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x, o)).hexdigest() for x, o in zip(ids, offsets)], [int(o[-1]) for o in offsets]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])
                at += len(group)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
