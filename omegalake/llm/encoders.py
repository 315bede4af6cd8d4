"""Whole-text encoding with the tokenizers library, in which repeated words cost one lookup.

Both vocabularies used here never merge across a single space between two visible
characters, nor between a letter and ASCII punctuation that follows it. So a text's ids are
the ids of its space-separated units in order, and a unit's ids are those of its letters and
then of its punctuation. Every distinct piece goes through the library once per worker; plain
Latin words go in together, a few hundred to a call. Texts are lowered, marked, split and told
apart as Arrow arrays; only distinct units become Python strings, to be looked up by number.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Remembered units of one worker, and how many of them, the earliest and so mostly the commonest, outlast an overflow
#: or the end of a task (a matter of speed and memory only).
MEMORY, KEPT = 500_000, 100_000

#: Texts taken apart at once.
TEXTS_A_STEP = 512

#: Words given to the library in one string.
WORDS_A_CALL = 256

_SPACE_RUN = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: ASCII punctuation, the apostrophe apart, and where it follows an ASCII letter.
_MARKS = r"[!-&(-/:-@\[-`{-~]"
_AFTER_LETTER = re.compile(f"(?<=[A-Za-z]){_MARKS}")
#: The first bytes of combining marks, which have code points from U+0300 on, and of all later characters.
_FIRST_MARK = 0xCC
_CAPITAL, _LETTER, _PUNCTUATION = (np.array([bool(re.match(kind, chr(c))) for c in range(256)]) for kind in ("[A-Z]", "[A-Za-z]", _MARKS))
#: Letters of the Latin blocks that stay one letter in lower case.
_LETTERS = "[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+"


def _marked_words(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """The texts with a space at every boundary; this vocabulary lower-cases, and doing so for ASCII first makes more units alike.

    The library composes before it lowers, and some marks compose with a small letter only: a
    capital before a character that may be such a mark stays as it is. A text's first character
    may count as following the last one of the text before, which changes no ids.
    """
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    after = data[1:]
    lowered = _CAPITAL[data]
    lowered[:-1] &= after < _FIRST_MARK
    cuts = np.flatnonzero(_LETTER[data[:-1]] & _PUNCTUATION[after]) + 1
    marked = np.insert(data + (lowered.view(np.uint8) << 5), cuts, ord(" "))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets + np.searchsorted(cuts, offsets)), pa.py_buffer(marked))


def _marked_bytes(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """The texts with a zero character at every boundary; none of them has such a character of its own."""

    def marked(text: str) -> str:
        text = _AFTER_LETTER.sub("\0\\g<0>", text)
        return _SINGLE_SPACE.sub("\0 ", text) if _SPACE_RUN.search(text) else text.replace(" ", "\0 ")

    return pa.array(map(marked, _strings(texts)), pa.large_string())


def _strings(texts: pa.Array) -> list[str]:
    """As ``to_pylist``, many times faster."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def _put(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """held, of which so many are used, with more behind them; a larger copy if there is no room."""
    if used + len(more) > len(held):
        held = np.concatenate([held[:used], np.empty(max(used, len(more)), held.dtype)])
    held[used : used + len(more)] = more
    return held


class UnitEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    keeps_spaces: whether the vocabulary holds words with their leading space (byte-level)
    or drops white space and marks the ends of words. Strings of special tokens inside a text
    are ordinary text.
    """

    def __init__(self, path: str, keeps_spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        self._keeps_spaces = keeps_spaces
        vocabulary = self._library.get_vocab()
        self._marks = np.zeros(max(vocabulary.values()) + 1, bool)  # first or last id of a word
        for token, k in vocabulary.items():
            self._marks[k] = token.startswith("Ġ") if keeps_spaces else token.endswith("</w>")
        self.size = len(self._marks)
        self._joiner = "" if keeps_spaces else " "
        self._marked, self._boundary = (_marked_bytes, "\0") if keeps_spaces else (_marked_words, " ")
        #: Words that go in together, and what encodes them.
        self._words = [(rf"\A{' ' if keeps_spaces else ''}{_LETTERS}\z", self._library)]
        if not keeps_spaces:  # small ASCII letters are normal and stand for themselves: all that is left to do is the model's
            plain = Tokenizer(self._library.model)
            plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self._words.insert(0, (r"\A[a-z]+\z", plain))
        #: Numbers of known units, from 0 in order; a unit's ids lie between its start and the next.
        self._known: dict[str, int] = {}
        self._ids, self._starts = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _remember(self, units: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(self._known)
        used = int(self._starts[n])
        self._known.update(zip(units, range(n, n + len(units))))
        self._ids, self._starts = _put(self._ids, used, ids), _put(self._starts, n + 1, used + ends)

    def _apart(self, pieces: list[str]) -> None:
        found = [e.ids for e in self._library.encode_batch_fast(pieces, add_special_tokens=False)]
        self._remember(pieces, np.array([k for ids in found for k in ids], "<u4"), np.cumsum([len(ids) for ids in found], dtype=np.int64))

    def _together(self, words: list[str], library) -> None:
        """words: runs of Latin letters; with a leading space each, if the vocabulary keeps spaces."""
        for at in range(0, len(words), WORDS_A_CALL):
            some = words[at : at + WORDS_A_CALL]
            ids = np.array(library.encode_batch_fast([self._joiner.join(some)], add_special_tokens=False)[0].ids, "<u4")
            marked = np.flatnonzero(self._marks[ids])
            if len(marked) != len(some):
                self._apart(some)
                continue
            self._remember(some, ids, np.append(marked[1:], len(ids)) if self._keeps_spaces else marked + 1)

    def _learn(self, units: pa.Array) -> None:
        for kind, library in self._words:
            own = pc.match_substring_regex(units, kind)
            self._together(_strings(units.filter(own)), library)
            units = units.filter(pc.invert(own))
        self._apart(_strings(units))

    def shrink(self) -> None:
        """Gives memory back to the machine: idle workers share it with other stages."""
        self._known = dict(islice(self._known.items(), KEPT))
        self._starts = self._starts[: len(self._known) + 1].copy()
        self._ids = self._ids[: self._starts[-1]].copy()
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        gc.disable()  # nothing here makes cycles, and scanning the memory for some takes long
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Units are told apart and counted as numbers by Arrow, looked up once each, and put together by numpy."""
        if not len(texts):
            return []
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        zero = pc.match_substring(texts, "\0") if self._keeps_spaces else pa.array([], pa.bool_())
        whole = {k: texts[k].as_py() for k in np.flatnonzero(zero.to_numpy(zero_copy_only=False)).tolist()}  # one unit each
        if whole:
            texts = pc.if_else(zero, pa.scalar("", pa.large_string()), texts)
        units = pc.split_pattern(self._marked(texts), self._boundary)
        numbered = units.flatten().dictionary_encode()
        distinct = _strings(numbered.dictionary)
        if len(self._known) + len(distinct) > MEMORY:
            self.shrink()
        numbers = np.fromiter(map(self._known.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            self._learn(numbered.dictionary.take(pa.array(fresh)))
            numbers[fresh] = [self._known[distinct[k]] for k in fresh.tolist()]
        starts = self._starts[numbers]
        which = numbered.indices.to_numpy()
        each = (self._starts[numbers + 1] - starts)[which]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        put = self._ids[np.repeat(starts[which] - (ends - each), each) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[units.offsets.to_numpy()]
        made = [put[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        for k, text in whole.items():
            made[k] = np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return made


_encoders: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, keeps_spaces: bool) -> UnitEncoder:
    """The worker's encoder for a vocabulary file."""
    key = (path, keeps_spaces)
    if key not in _encoders:
        _encoders[key] = UnitEncoder(path, keeps_spaces)
    return _encoders[key]
