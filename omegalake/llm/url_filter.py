"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules are packed into one multiword Shift-And automaton: a bit for each state of each rule, a mask for
each byte that says which states may be entered with it, and one that says which may be stayed in. All rules
advance together, a byte of every URL of a batch at a time.

In a glob, ``*`` stands for any text without a slash, ``**`` for any text, ``?`` for one byte other than a
slash; all else stands for itself. Globs are matched against host and path (``example.com/en/1``).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules by host and start of the path, for a host and its subdomains; the longest that fits decides.
HOST_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: Globs for URLs that no rule by host fits. The longest (by literal characters) that matches decides, block before allow; none: allow.
GLOBS = (
    *((f"*{word}*{rest}", "block") for word in ("spam", "casino", "poker", "viagra", "cheap-pills", "porn", "xxx", "warez", "torrent", "payday-loan", "lottery") for rest in ("", "/**")),
    *((f"**/{part}", "block") for part in (
        "wp-admin/**", "wp-login.php", "cgi-bin/**", "login", "login/**", "signin", "signin/**", "signup", "signup/**", "register", "register/**", "cart", "cart/**", "checkout", "checkout/**",
        "search", "search/**", "tag/**", "tags/**", "feed", "feed/**", "rss", "print/**", "*.exe", "*.zip", "*.apk", "*.jpg", "*.jpeg", "*.png", "*.gif", "*.mp3", "*.mp4",
    )),
    ("ads.**", "block"), ("ad.**", "block"), ("*.doubleclick.net", "block"), ("*.doubleclick.net/**", "block"), ("localhost", "block"), ("localhost/**", "block"),
    ("*.edu/**", "allow"), ("*.gov/**", "allow"), ("*.wikipedia.org/wiki/**", "allow"),
)

#: URLs judged at once by one task, by bytes of host and path.
BATCH_BYTES = 4 << 20


class Rule(NamedTuple):
    glob: str
    name: str
    by_host: bool
    length: int  # the longest that matches wins
    verdict: str


def host_globs(host: str, path: str) -> tuple[str, str]:
    """The host itself and its subdomains. The first slash ends the host, so ``**`` may stand for subdomains only where no slash comes: hosts have none."""
    return f"{host}{path}**", f"*.{host}{path}**"


def literal_length(glob: str) -> int:
    return len(glob.replace("*", ""))


class Automaton:
    """Simulates all globs at once."""

    def __init__(self, globs: Iterable[str]):
        enter, stay, starts, ends = [], [], [], []  # for each state, a set of bytes
        every, plain = frozenset(range(256)), frozenset(range(256)) - {ord("/")}
        for glob in globs:
            starts.append(len(enter))
            enter.append(frozenset())
            stay.append(frozenset())
            rest = glob.encode()
            while rest:
                if rest[:1] == b"*":
                    stay[-1] = stay[-1] | (every if rest[:2] == b"**" else plain)
                    rest = rest.lstrip(b"*") if rest[:2] == b"**" else rest[1:]
                else:
                    enter.append(plain if rest[:1] == b"?" else frozenset(rest[:1]))
                    stay.append(frozenset())
                    rest = rest[1:]
            ends.append(len(enter) - 1)
        self.words = len(enter) // 64 + 1
        self.enter, self.stay = self._masks(enter), self._masks(stay)
        self.start = self._packed(starts)
        self.ends = [(e // 64, np.uint64(e % 64)) for e in ends]

    def _packed(self, states: Iterable[int]) -> np.ndarray:
        found = np.zeros(self.words, np.uint64)
        for s in states:
            found[s // 64] |= np.uint64(1 << (s % 64))
        return found

    def _masks(self, classes: list[frozenset[int]]) -> np.ndarray:
        return np.stack([self._packed(s for s, c in enumerate(classes) if b in c) for b in range(256)])

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, glob) -> whether it matches, for texts ``data[offsets[k]:offsets[k + 1]]``."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")  # texts that have ended are a tail
        at, left = offsets[:-1][order], lengths[order]
        state = np.repeat(self.start[None], len(order), axis=0)
        going = len(order)
        for step in range(int(left[0]) if len(left) else 0):
            going = int(np.searchsorted(-left[:going], -step, side="left"))
            now, byte = state[:going], data[at[:going] + step]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:going] = (moved & self.enter[byte]) | (now & self.stay[byte])
        found = np.empty((len(order), len(self.ends)), bool)
        for k, (word, bit) in enumerate(self.ends):
            found[order, k] = (state[:, word] >> bit) & np.uint64(1)
        return found


@functools.lru_cache(8)
def _automaton(globs: tuple[str, ...]) -> Automaton:
    return Automaton(globs)


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of BATCH_BYTES or one text more."""
    low = size = 0
    for k, n in enumerate(lengths):
        size += n + 64
        if size > BATCH_BYTES or k + 1 == len(lengths):
            yield low, k + 1
            low, size = k + 1, 0


def first_matches(globs: Iterable[str]) -> Callable[[Column, Column], Column]:
    """A column function of host and path: the number, from 1, of the first glob that matches, 0 if none does."""
    globs = tuple(globs)

    def picked(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        texts = [(h + p).encode("utf-8", "surrogatepass") for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
        found = np.zeros(len(texts), np.int32)
        for low, high in _slices([len(x) for x in texts]) if globs else ():
            offsets = np.cumsum([0, *(len(x) for x in texts[low:high])], dtype=np.int64)
            hit = _automaton(globs).matches(np.frombuffer(b"".join(texts[low:high]) + b"\0", np.uint8), offsets)
            found[low:high] = np.where(hit.any(1), hit.argmax(1) + 1, 0)
        return pa.array(found)

    return F.arrow_udf(picked, "int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    known = F.coalesce(url, F.lit(""))
    start = F.instr(known, "://")
    rest = F.when(start > 0, F.substring(known, start + 3, F.length(known))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _ranked(host_rules: Iterable[tuple[str, str, str]], globs: Iterable[tuple[str, str]]) -> list[Rule]:
    """All rules as globs, best first."""
    by_host = [Rule(g, h + p, True, len(h + p), v) for h, p, v in host_rules for g in host_globs(h, p)]
    others = [Rule(g, g, False, literal_length(g), v) for g, v in globs]
    return sorted(by_host + others, key=lambda r: (not r.by_host, -r.length, r.verdict != "block", r.name))


def judge(pages: DataFrame, host_rules: Iterable[tuple[str, str, str]] = HOST_RULES, globs: Iterable[tuple[str, str]] = GLOBS, url: str = "url") -> DataFrame:
    """Adds host, path, rule (``host`` and ``path`` of the rule by host that decides, else null), glob (the glob that
    decides where no such rule does, else null) and verdict (``allow`` or ``block``); columns of these names are replaced.

    Rules by host go into the automaton as globs, too. Among those that fit, and then among globs, the longest wins,
    of equals one that blocks, then the least; where none matches, the verdict is allow. Null URLs and those without
    ``://`` have an empty host and path and are judged like any other. Every row is judged, repeated ones alike.
    """
    ranked = _ranked(host_rules, globs)
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "glob", "verdict")]
    host, path = host_and_path(F.col(f"`{url}`"))
    parts = pages.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path"))
    found = parts.withColumn("at", first_matches(r.glob for r in ranked)("host", "path"))

    def of(values: Iterable[str | None]) -> Column:
        return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.col("at"))

    names = of([None, *(r.name if r.by_host else None for r in ranked)]).alias("rule"), of([None, *(None if r.by_host else r.name for r in ranked)]).alias("glob")
    return found.select("row.*", "host", "path", *names, of(["allow", *(r.verdict for r in ranked)]).alias("verdict"))


def _pattern(glob: str) -> str:
    return "".join(".*" if x[:2] == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x) for x in re.findall(r"\*\*+|\*|\?|[^*?]+", glob))


_CASES = _ranked(HOST_RULES, GLOBS)
_WHEN = [f"WHEN regexp_full_match(host || path, '{_pattern(r.glob)}', 's')" for r in _CASES]
ORACLE_SQL = rf"""
SELECT page_id, host, path,
  CASE {" ".join(f"{w} THEN '{r.name}'" for w, r in zip(_WHEN, _CASES) if r.by_host)} END AS rule,
  CASE {" ".join(f"{w} THEN {'NULL' if r.by_host else repr(r.name)}" for w, r in zip(_WHEN, _CASES))} END AS glob,
  CASE {" ".join(f"{w} THEN '{r.verdict}'" for w, r in zip(_WHEN, _CASES))} ELSE 'allow' END AS verdict
FROM (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages))
"""
