"""Conversation repair, the prefix trie and URL filters against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from omegalake.llm import conversation_repair, prefix_trie, queries, url_filter

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
CLASHING = ("conv", "block", "position", "row", "n", "key", "parent", "depth", "symbol", "fault", "_row", "_weight", "host", "rule")


def _clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def _rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


# Repair.


def plain_damage(rows):
    found = {}
    for c, t, r, x in rows:
        kept = found.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            kept += [(t, "user" if kind == 4 else r, x)] * (1 + (kind == 3))
    return found


def plain_repair(messages):
    """Every way to edit, by plain relaxation over the role of the last message."""
    messages = sorted(messages, key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
    turns = {m[0] for m in messages if m[0] is not None}
    seen, faults = set(), []
    for _, r, x in messages:
        bare = x.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    follows, full = {"": "su", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

    def better(ways, last, way):
        if last not in ways or way[:2] < ways[last][:2]:
            ways[last] = way
            return True
        return False

    def with_inserts(ways):
        while any([better(ways, q, (c + 2, a + "I", o + [full[q] + ":"])) for s, (c, a, o) in list(ways.items()) for q in follows[s] if q in full]):
            pass
        return ways

    ways = with_inserts({"": (0, "", [])})
    for (_, r, x), fault in zip(messages, faults):
        following, more = {}, fault == "truncated"
        for s, (c, a, o) in ways.items():
            better(following, s, (c + 3, a + "D", o))
            for q in follows[s] if fault not in ("blank", "duplicate") else "":
                if r[:1] == q:
                    better(following, q, (c + more, a + "K", o + [f"{r}:{x}"]))
                if q in full:
                    better(following, q, (c + 2 + more, a + "R", o + [f"{full[q]}:{x}"]))
        ways = with_inserts(following)
    cost, audit, lines = min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _messages(n, convs, seed):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", "", "Übung"]
    texts = [None, "", " \n", "a.", "b", "Hi!", "c? ", "d.\n x", "é.", "z", "q.", "\x0bq!\x0c", "a.\x85"]
    return [(r.choice([None, *range(convs)]), r.choice([None, None, *range(40)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


def _reports(df, most=conversation_repair.BLOCK_WEIGHT):
    return {r[0]: tuple(r[1:]) for r in conversation_repair.reports(conversation_repair.damaged(df), df, most).collect()}


@pytest.mark.parametrize("n, convs, most", [(1500, 250, 1 << 24), (1200, 4, 1 << 15), (900, 40, 1 << 17), (0, 1, 1 << 24)])
def test_repairs_are_the_cheapest(spark, monkeypatch, n, convs, most):
    monkeypatch.setattr(conversation_repair, "FOLD", 3)
    rows = _messages(n, convs, n)
    assert _reports(_clashing(spark.createDataFrame(rows, SCHEMA)), most) == {c: plain_repair(m) for c, m in plain_damage(rows).items()}


def test_repair_query_equals_the_plain_version(spark, sf_dir):
    found = queries.op11_conversation_repair(spark, sf_dir)
    assert found.columns[:6] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal"]
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {c: plain_repair(m) for c, m in plain_damage(_rows(spark, sf_dir)).items()}


def test_chart_of_a_long_conversation_is_linear_and_blocks_compose():
    r = random.Random(1)
    signature = "".join(r.choice("suaxSUAXD") for _ in range(3000))
    whole = conversation_repair.parse(signature)
    cut = [conversation_repair._table(signature[k : k + 450]) for k in range(0, 3000, 450)]
    table = cut[0]
    for t in cut[1:]:
        table = conversation_repair.composed(table, t)
    assert {x["end"]: (x["cost"], x["audit"]) for x in table if x["start"] == conversation_repair.EMPTY} == whole


def test_repaired_messages_keep_text_and_long_texts(spark):
    long = "a long text. " * 200_000
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", long), (1, 2, "user", "And?"), (1, 3, "assistant", "Yes.")]
    found = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA)).first()
    assert (found.cost, found.audit) == (2, "KKIKK")
    assert [(m.edit, m.role, m.text) for m in found.messages] == [("K", "system", "Be kind."), ("K", "user", long), ("I", "assistant", ""), ("K", "user", "And?"), ("K", "assistant", "Yes.")]


# URL filters.


def _by_rules(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "http://Com/x", "http://a.com", "http://a.com?q=/en/", "http://a.com#/en/", "https://EXAMPLE.com/en/1", "https://www.example.com/en/?x", "https://a.www.example.com/en/",
    "http://notexample.com/en/", "http://xcom/", "http://a.net/es/", "http://a.net/fr/b#c", "http://a.net/es", "http://net/es/x", "http://a.org/a.com/", "ftp://x://b.com/", "http://É.com/ÀÈ/é", "http://a.com:80/", "http://u@a.com/\n\n/x",
    "http://spam-farm.example.org/en/1", "http://casino.net/en/", "http://a.org/wp-admin/x.php", "http://a.org/x/photo.jpg", "http://a.org/x.jpg/y", "http://a.org/" + "x/" * 200_000, "http://.com/",
]


def test_rules_by_host(spark):
    df = _clashing(spark.createDataFrame([(k, u) for k, u in enumerate(URLS + URLS)], "page_id long, url string"))
    found = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(found) == 2 * len(URLS)
    for k, url in enumerate(URLS + URLS):
        host, path, rule = _by_rules(url)
        got = found[k]
        assert (got.host, got.path, got.rule) == (host, path, rule and rule[0]), url
        assert (got.glob is None and got.verdict == rule[1]) if rule else (got.verdict == "allow" or got.glob), url
    by = {u: found[k] for k, u in enumerate(URLS)}
    assert by["http://spam-farm.example.org/en/1"].verdict == by["http://casino.net/en/"].verdict == by["http://a.org/wp-admin/x.php"].verdict == by["http://a.org/x/photo.jpg"].verdict == "block"
    assert by["http://a.org/x.jpg/y"].verdict == "allow"
    assert url_filter.judge(df.where("false")).count() == 0
    assert {r.verdict for r in url_filter.judge(df, (), ()).collect()} == {"allow"}


def test_automaton_equals_regular_expressions():
    r = random.Random(1)
    globs = ["".join(r.choice(["a", "b", "/", "*", "**", "?", ".", "ab", "é"]) for _ in range(r.randint(0, 12))) for _ in range(120)]
    texts = ["".join(r.choice("aab//.éb") for _ in range(r.randint(0, 25))).encode() for _ in range(1500)]
    offsets = np.cumsum([0, *map(len, texts)])
    found = url_filter.Automaton(globs).matches(np.frombuffer(b"".join(texts), np.uint8), offsets)
    kinds = {"*": b"[^/]*", "?": b"[^/]"}
    for k, glob in enumerate(globs):
        parts = re.findall(r"\*\*+|\*|\?|[^*?]+", glob)
        pattern = re.compile(b"".join(rb".*" if x[:2] == "**" else kinds.get(x, re.escape(x.encode())) for x in parts), re.S)
        assert found[:, k].tolist() == [bool(pattern.fullmatch(t)) for t in texts], glob


def test_url_filter_equals_sql(spark, sf_dir):
    compare(queries.op12_url_filter(spark, sf_dir), url_filter.ORACLE_SQL, sf_dir)


# The prefix trie.


def plain_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            told = f"{len(r or '')}:{r or ''}{x or ''}"
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256(told.encode()).digest()[:16], x or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    members, children, leaves, saved = {}, {}, {}, {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path)))
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    found = []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c, n in members[p] if n == len(p))
        found.append((members[p][0][0], len(p), members[p[:-1]][0][0] if p else None, len(members[p]), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _turns(n, convs, turns, seed):
    r = random.Random(seed)
    return [(r.choice([None, *range(convs)]), r.choice([None, *range(turns)]), r.choice(["user", "assistant", None]), r.choice([None, "", "a", "b", "é🙂"])) for _ in range(n)]


@pytest.mark.parametrize("rows, block", [
    (_turns(1500, 500, 6, 1), 4096),
    (_turns(1500, 12, 200, 2), 16),
    ([(c, t, "u", "x") for c in range(12) for t in range(40 + c)] + [(200, t, "u", "x") for t in range(20)], 16),
    ([(c, 0, "u", "x") for c in range(700)], 4096),
    ([], 4096),
])
def test_trie_equals_the_plain_version(spark, rows, block):
    df = _clashing(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(df, block).collect()), key=str) == plain_trie(rows)


def test_trie_query_equals_the_plain_version(spark, sf_dir):
    assert sorted((tuple(r[c] for c in COLUMNS) for r in queries.op13_prefix_trie(spark, sf_dir).collect()), key=str) == plain_trie(_rows(spark, sf_dir))
