"""The training-data operators against brute force, the libraries they stand for, and awkward tables."""

import base64
import hashlib
import random
import re
import string
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from oracle import compare
from pyspark.sql import functions as F

from omegalake.llm import byte_bpe, common, encoders, hash_forest, html_extract, license_scan, mphf, packing, quality_net, quality_rules, queries, quote_linking, simhash, token_shards

WORDS, BYTES, MULTI = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")

#: Texts that operators tend to stumble over.
TEXTS = [
    None, "", " ", "\n\n", "a", "it's 'S I'LL x's", "a  b   c \n d\n\n e\t f", "<|endoftext|> a<|endoftext|>b", "é é Σας İstanbul ﬁ", "漢字 かな 🙂🙂 a b c", "123 4567 8.9 ²", "x" * 3000, "\r\n a\r\n b", "\x00\x1c a", "Don't!!! (stop) [now] **bold** ###",
    "All rights reserved. CC BY 4.0, general public license", "all\nrights, reserved all rights reserved", "the same words again " * 40, "one two three four five six seven eight nine ten " * 6 + "end.",
]


def _fuzz(n, seed, more=()):
    r = random.Random(seed)
    parts = [*" \n\t'", "  ", "'s", "'ll", "re", "the", "The", " and", "é", "漢", "🙂", "٣", "ⅷ", "!", "...", "###", *string.ascii_letters[:8], *"0123", *more]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and repeated ids, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(k if k else None, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (5, "another text under the same id"), (5, "another text under the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("k", "t", "s", "v", "h", "fp", "row", "word", "rank", "length", "piece", "_row", "kept", "ids", "content", "lang", "_fp", "_first", "_part", "_rank", "_n", "_base", "n", "root", "hash", "repeated", "order", "id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def _rows(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# Encoders and hashing.


@pytest.mark.parametrize("path, keeps", [(WORDS, False), (BYTES, True)])
def test_units_encode_as_the_library_does(path, keeps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    marked = ["T\u0308", "H\u0331", "W\u030a", "Y\u030a", "J\u030c", "H\u0331ad a", "HTML A漢B", "T\u0323\u0308", "I\u0307", "\u212a\u0308"]
    texts = [t or "" for t in TEXTS] + marked + _fuzz(600, 1) + _fuzz(3000, 21, [chr(c) for c in range(0x300, 0x330)] + list("THWYJKthwyj"))
    for t, ids in zip(texts, encoders.UnitEncoder(path, keeps).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_memory_overflow_changes_nothing(monkeypatch):
    texts = _fuzz(50, 2)
    whole = encoders.UnitEncoder(BYTES, True).encode(texts)
    monkeypatch.setattr(encoders, "MEMORY", 5)
    small = encoders.UnitEncoder(BYTES, True)
    assert [x for t in texts for x in small.encode([t])] == whole


@pytest.mark.parametrize(("path", "keeps"), [(WORDS, False), (BYTES, True)])
def test_arrow_columns_are_encoded(path, keeps):
    """A slice of a column, with texts whose borders look like inner boundaries, and every unit learnt in a text of its own or in all."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = ["gone", "end A", "\u0308 mark", "B", "!", "", "", "word", ".word", "a\0b", " ", "T\u0308T", "plain Word élan Élan don't DON'T x", "plain", "word élan"]
    column = pa.array(texts).slice(1)
    for own in (column, column.slice(3, 4), column.slice(0, 0)):
        got = encoders.UnitEncoder(path, keeps).encode(own)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [library.encode(t, add_special_tokens=False).ids for t in own.to_pylist()]


def test_known_words_cost_little():
    """Within some times the CPU time in which Arrow splits the texts and tells their words apart (7 to 8 times when each text and each id list was a Python object, 3 now)."""
    r = np.random.default_rng(5)
    words = np.array(["".join(w) for w in r.choice(list("aeioulnrst"), (40_000, 7))])
    texts = [" ".join(w) + "." for w in r.choice(words, (512, 500))]
    own = encoders.UnitEncoder(WORDS, False)
    own.encode(texts)

    def least(run) -> float:
        times = []
        for _ in range(5):
            start = time.process_time()
            run()
            times.append(time.process_time() - start)
        return min(times)

    assert least(lambda: own.encode(texts)) < 4.5 * least(lambda: pc.split_pattern(pa.array(texts), " ").flatten().dictionary_encode())


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20000])
def test_minimal_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64) - (1 << 39)
    h = mphf.MinimalPerfectHash.build(keys)
    assert sorted(h(keys).tolist()) == list(range(n))


# 1: token shards.


def test_shards(spark, awkward, empty, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_shards, "BLOCK_IDS", 50)
    path = f"file://{tmp_path}/shards"
    token_shards.write_shards(awkward, path, WORDS)
    shards = token_shards.read_shards(spark, path)
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    ids = defaultdict(list)
    for k, t in _rows(awkward):
        ids[k].append([*library.encode(t, add_special_tokens=False).ids, 2])
    got = sorted(token_shards.shard_rows(shards).collect(), key=lambda r: r.start)
    assert [r.key is None for r in got][0] and len(got) == awkward.count()
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        assert r.ids_crc32 in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r.key]]
    keys = [r.key for r in got if r.key is not None]
    assert keys == sorted(keys)
    found = {r.key: r.ids for r in token_shards.look_up(shards, [1, 5, 7, 99, -4, 4, 1 << 40]).collect()}
    assert set(found) == {1, 4, 5, 7} and found[7] in ids[7] and found[5] in ids[5]
    assert token_shards.look_up(shards, []).count() == 0
    token_shards.write_shards(empty, f"file://{tmp_path}/none", WORDS)
    assert token_shards.shard_rows(token_shards.read_shards(spark, f"file://{tmp_path}/none")).count() == 0


def test_rows_come_through_the_hash():
    lists = [np.arange(k, 2 * k + 1, dtype="<u4").tobytes() for k in range(6)]
    keys = [None, None, 3, 3, 8, 9]
    b = token_shards.Block(*token_shards.pack_block(keys, lists, 4))
    assert b.looked_up().tolist() == [0, 1, 2, 3, 4, 5] and b.find(np.array([3, 4, 77, -1])).tolist() == [2, -1, -1, -1]
    b._rows = b._rows[::-1]  # a broken index shows
    assert b.looked_up().tolist() != [0, 1, 2, 3, 4, 5]
    b._marks = b._marks + np.uint32(1)
    with pytest.raises(ValueError):
        b.looked_up()


def test_op1_starts(spark, sf_dir):
    rows = queries.op1_token_shards(spark, sf_dir).orderBy("doc_id").collect()
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()


# 2: quality network.


def test_gradients_agree_with_differences():
    r = np.random.default_rng(0)
    texts, y, w = [bytes(r.integers(1, 256, n)) for n in (5, 700, 1500)], np.array([1.0, 0.0, 1.0]), np.ones(3)
    net = quality_net.QualityNet()
    for name in ("embedding", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias += r.normal(0, 0.1, net.bias.shape)  # padding answers with the bias: at 0 there would be a kink

    def loss():
        p = net.scores(texts)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for x, g in zip(net.parameters(), net._gradients(texts, y, w)):
        for at in [tuple(r.integers(0, n) for n in x.shape) for _ in range(6)]:
            if x is net.embedding and at[0] == 0:
                continue
            keep = x[at]
            x[at] = keep + 1e-5
            up = loss()
            x[at] = keep - 1e-5
            down = loss()
            x[at] = keep
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=2e-4)


def _plain_score(net, text):
    """The network by plain loops over windows and chunks."""
    n = max(1, -(-len(text) // 64))
    data = text.ljust(64 * n + 4, b"\0")
    answers = []
    for w in range(16 * n):
        window = np.concatenate([net.embedding[b] for b in data[4 * w : 4 * w + 8]])
        answers.append([max(0.0, float(window @ net.filters[:, f] + net.bias[f])) for f in range(quality_net.FILTERS)])
    answers = np.array(answers)
    chunks = [answers[16 * a : 16 * min(a + 9, n)].max(axis=0) for a in range(0, max(1, n - 1), 8)]
    x = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)]) @ net.out + net.out_bias[0]
    return 1 / (1 + np.exp(-x))


def test_scores_against_plain_loops(monkeypatch):
    r, net = np.random.default_rng(1), quality_net.QualityNet()
    net.bias += r.normal(0, 0.1, net.bias.shape).astype(np.float32)
    texts = [b"", b"a", *(bytes(r.integers(1, 256, n)) for n in (63, 64, 65, 127, 128, 575, 576, 577, 1090, 4000))]
    wanted = [_plain_score(net, t) for t in texts]
    assert np.allclose(net.scores(texts), wanted, atol=1e-5)
    for at_once in (1, 600, 1100):  # long texts in parts
        monkeypatch.setattr(quality_net, "AT_ONCE", at_once)
        assert np.allclose(net.scores(texts), wanted, atol=1e-5)


def test_chunks_cover_documents():
    for n in (1, 2, 8, 9, 10, 17, 100):
        spans, counts = quality_net.QualityNet._chunks(np.array([0, n, n + 3]))
        own = spans[: counts[0]]
        assert own[0][0] == 0 and own[-1][1] == n and all(b[0] == a[1] - 1 for a, b in zip(own, own[1:]))


def test_scores_do_not_depend_on_the_batch():
    net, texts = quality_net.QualityNet(), [(t or "").encode() for t in TEXTS]
    together = net.scores(texts)
    assert np.allclose(together, [net.scores([t])[0] for t in texts], atol=1e-5)
    assert ((together >= 0) & (together <= 1)).all()


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    found = queries.op2_quality_net(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    held = [(r.quality, r.predicted) for r in found.where("held_out").collect()]
    assert np.mean([q == p for q, p in held]) >= 0.88
    assert np.mean([p for q, p in held if q == 1]) >= 0.95


def test_quality_edges(spark, awkward, empty):
    net = quality_net.QualityNet()
    got = quality_net.score(awkward, net).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert quality_net.score(empty, net).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert np.array_equal(quality_net.fit_on_labels(awkward, labels).filters, net.filters)
    # Of several labels of an id the smallest counts, whatever the order of rows.
    twice = [(4, 1, 0), (4, 0, 0), (6, 1, 0), (None, 1, 0), (7, None, 0)]
    nets = [quality_net.fit_on_labels(awkward, spark.createDataFrame(rows, labels.schema)) for rows in (twice, twice[::-1], [(4, 0, 0), (6, 1, 0)])]
    assert all(np.array_equal(n.filters, nets[2].filters) for n in nets)


# 3: hash forest.


def test_forest_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 16))
    x[100:400] = x[0]  # a frequent vector
    x[400:420] = 2 * x[1]
    rows = [(int(k), [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None, *[1.0] * 15]), (1200, [1.0, 2.0]), (1250, [3.0, 4.0]), (1300, [1.0, 0.0]), (None, [1.0] * 16), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for row in hash_forest.nearest(df, df.where("vec_id % 50 = 0"), 5, trees=8, window=128).collect():
        got[row.query_id].append((row.rank, row.vec_id, row.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    assert set(got) == {*range(0, 900, 50), 1200, 1250, 1300}
    assert [f[1:] for f in sorted(got.pop(1200))] == [(1250, pytest.approx(11 / 125**0.5)), (1300, pytest.approx(1 / 5**0.5))]
    got.pop(1250), got.pop(1300)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and q not in [f[1] for f in found]
        cosine = unit @ unit[q]
        cosine[q] = -9
        best = np.lexsort((np.arange(900), -np.round(cosine, 12)))[:5]
        hits += len({f[1] for f in found} & set(best.tolist()))
        assert all(abs(cosine[v] - s) < 1e-12 for _, v, s in found)
    assert hits >= 0.9 * 5 * len(got)
    assert [f[1] for f in got[150]] == [0, 100, 101, 102, 103]  # ties: the smaller ids


def test_forest_ties_and_partitions(spark):
    """Scaled copies are different vectors with equal cosines; the number of partitions changes no row."""
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 8))
    x[100:300] = x[50] * 2.0 ** r.integers(-20, 20, (200, 1))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows.append(sorted(hash_forest.nearest(df, df.where("vec_id % 50 = 0"), 5, trees=6, window=60).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows[0] == rows[1]
    found = {q: [v for a, _, v, _ in rows[0] if a == q] for q in (50, 100, 150)}
    assert found == {50: [100, 101, 102, 103, 104], 100: [50, 101, 102, 103, 104], 150: [50, 100, 101, 102, 103]}


def test_forest_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in hash_forest.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert hash_forest.nearest(df.where("false"), df.where("false")).count() == 0
    assert hash_forest.nearest(df.where("vec_id = 0"), df).count() == 0


def test_forest_has_no_switch(spark):
    """A small table is searched as any other: only the number of rows to meet counts."""
    n = 401
    window, odd = divmod(int(hash_forest.SHARE * n**hash_forest.POWER), 2)
    assert not odd
    df = spark.createDataFrame([(k, v) for k, v in enumerate(np.random.default_rng(8).normal(size=(n, 64)).tolist())], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    assert sorted(hash_forest.nearest(df, asked, trees=1).collect()) == sorted(hash_forest.nearest(df, asked, trees=1, window=window).collect())


def test_forest_ascends_until_enough_are_found(spark):
    """Nothing shares a prefix with the query, not even a sign."""
    df = spark.createDataFrame([(0, [3.0]), *((k, [-float(k)]) for k in range(1, 9))], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in sorted(hash_forest.nearest(df, df.where("vec_id = 0"), trees=3, window=1).collect())] == [(0, k, k, -1.0) for k in range(1, 6)]
    # Fewer than asked for: all.
    assert sorted(r.vec_id for r in hash_forest.nearest(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()) == [1, 2, 3]


@pytest.mark.parametrize("n", [300, 1_000, 2_500])
def test_forest_recall_on_small_tables(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    assert _recall(x, hash_forest.nearest(df, df.where("vec_id % 20 = 0"), 5).collect()) >= 0.9


def test_op3_recall(spark, sf_dir):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    unit = np.stack([vectors[k] / np.linalg.norm(vectors[k]) for k in ids])
    got = defaultdict(set)
    for r in queries.op3_hash_forest(spark, sf_dir).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        hits += len(set(ids[np.argsort(-s)[:5]].tolist()) & got[q])
    assert hits >= 0.9 * 5 * len(got)


def _recall(x, found):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got, hits = defaultdict(set), 0
    for r in found:
        got[r.query_id].add(r.vec_id)
    for q, ids in got.items():
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & ids)
    return hits / (5 * len(got))


def test_forest_on_a_hot_group(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(14_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[2000:] = x[2000] + 0.01 * r.normal(size=(12_000, 64))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    assert _recall(x, hash_forest.nearest(df, df.where("vec_id % 100 = 0"), 5).collect()) >= 0.9


# 4: SimHash.


def _plain_fingerprint(text):
    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(values, distance=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    own = np.array(sorted(values), np.uint64)
    for a, b in zip(*np.nonzero(np.bitwise_count(own[:, None] ^ own[None, :]) <= distance)):
        x, y = find(int(own[a])), find(int(own[b]))
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", TEXTS + _fuzz(40, 5))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _plain_fingerprint(text)


def test_links_are_lossless(spark):
    """Chains and clouds of fingerprints one to five bits apart, of both parities, in both halves."""
    r, values = random.Random(9), set()
    for _ in range(40):
        v = r.getrandbits(64)
        for _ in range(12):
            values.add(v)
            for b in r.sample(range(64), r.choice([1, 2, 3, 3, 3, 4, 5])):
                v ^= 1 << b
    values |= {0, (1 << 64) - 1, 1 << 63, 7}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    nodes = spark.createDataFrame(signed, "fp long")
    found = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(nodes)).collect()}
    wanted, groups, got = _components(values), defaultdict(set), defaultdict(set)
    for v in values:
        groups[wanted[v]].add(v)
        got[found.get(v, v - (1 << 64) if v >> 63 else v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_fingerprints_travel_instead_of_variants(spark):
    """Every variant is made once, equal ones in one partition, and after the shuffle, which carries far fewer rows."""
    r = random.Random(4)
    values = [0, (1 << 64) - 1, 1 << 63, 7, *(r.getrandbits(64) for _ in range(8))]
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    made = simhash._variants(nodes, 7)
    rows = made.select("v", "fp", F.spark_partition_id().alias("part")).collect()
    masks = {0: simhash._FAR, 1: simhash._NEAR}
    wanted = sorted((simhash._signed(v ^ m), simhash._signed(v)) for v in values for m in masks[v.bit_count() % 2])
    assert sorted((x.v, x.fp) for x in rows) == wanted
    parts = defaultdict(set)
    for x in rows:
        parts[x.v].add(x.part)
    assert all(len(p) == 1 for p in parts.values()) and len({x.part for x in rows}) == 7
    plan = simhash.links(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [v#" not in plan and plan.index("explode") < plan.index("RepartitionByExpression")
    for partitions in (1, 8, 400, 20_000):
        groups = simhash._bit_groups(partitions)
        assert sum(groups) == (1 << 64) - 1 and sum(g.bit_count() for g in groups) == 64 and 1 << len(groups) >= partitions << simhash._SPARE
        moves = [len({tuple((m & g).bit_count() % 2 for g in groups) for m in some}) for some in masks.values()]
        assert sum(moves) * 5 < sum(map(len, masks.values()))


def test_near_duplicates_edges(spark, awkward, empty):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    roots = _components({_plain_fingerprint(t) for _, t in _rows(awkward)})
    least = {}
    for k, t in _rows(awkward):
        g = roots[_plain_fingerprint(t)]
        least[g] = min((x for x in (least.get(g), k) if x is not None), default=None)
    assert all(r.component_id == least[roots[r.fp % (1 << 64)]] for r in got)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.distinct_documents(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert {roots[_plain_fingerprint(r.text)] for r in kept.collect()} == set(least)
    # One id bears two texts and is the smallest of both groups: neither group goes. Of equal ids and texts one row stays, always the same.
    twice = [(1, "a b c d e", "x"), (1, "p q r s t", "x"), (2, "a b c d e", "x"), (3, "p q r s t", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "x")]
    both = [simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() for rows in (twice, twice[::-1])]
    assert sorted(both[0]) == sorted(both[1]) and sorted((r.doc_id, r.text) for r in both[0]) == [(1, "a b c d e"), (1, "p q r s t")]
    nameless = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (None, "p q r s")], "doc_id long, text string")
    assert simhash.distinct_documents(nameless).count() == 2


def test_giant_component_and_hot_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    chain = [(k + 1, k) for k in range(1500)] + [(0, -k) for k in range(1, 1500)] + [(5000, 5001)]
    edges = spark.createDataFrame(random.Random(1).sample(chain, len(chain)), "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert len(got) == 3002 and set(got.values()) == {-1499, 5000} and got[1500] == -1499 and got[5001] == 5000
    docs = spark.createDataFrame([(k, "" if k % 3 else f"text number {k} of these") for k in range(600)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(found) == 600 and all(found[k] == 1 for k in range(600) if k % 3)


def test_fingerprint_in_blocks(monkeypatch):
    texts = [t for t in TEXTS if t] + _fuzz(40, 8) + ["one two three four five " * 30]
    whole = [simhash.fingerprint(t) for t in texts]
    for n in (1, 2, 5, 17):
        monkeypatch.setattr(simhash, "BLOCK_BYTES", n)
        assert [simhash.fingerprint(t) for t in texts] == whole


# 5 and 6: licences and rules.


def test_every_notice_is_found(spark):
    """Each notice between other words, also with one of its words changed that is not in its key phrase; the key phrase alone is not enough."""
    rows = []
    for number, (_, phrase, words) in enumerate(license_scan.TEMPLATES):
        own = [w for w in words.split() if w not in license_scan.COMMON]
        inside = [w for w in own if w not in phrase.split()]
        rows.append((2 * number, f"Some words, then: {words.upper()}! And more."))
        rows.append((2 * number + 1, "x " * 9 + (words.replace(inside[0], "changed", 1) if len(own) > 4 and inside else words)))
    rows.append((1000, "with or without fee. held liable for any damages arising"))
    found = {r.doc_id: set(r.labels.split(",")) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({label for label, _, _ in license_scan.TEMPLATES}) >= 40
    for number, (label, _, words) in enumerate(license_scan.TEMPLATES):
        assert label in found[2 * number] and label in found[2 * number + 1], (label, words)
    assert found[1000] == {""}


@pytest.mark.parametrize("name", ["op5_license_scan", "op6_line_first_rules"])
def test_native_against_sql(spark, sf_dir, name):
    compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name, apply", [("op5_license_scan", license_scan.scan), ("op6_line_first_rules", lambda df: quality_rules.apply_rules(df).drop("clean_text"))])
def test_native_edges(spark, awkward, empty, tmp_path, name, apply):
    # DuckDB's strings end at no zero byte, but its row order decides which repeated id is which; ids are made distinct.
    df = awkward.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "k", "s", "word")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations").split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    compare(apply(spark.read.parquet(f"{tmp_path}/documents.parquet")), queries.ORACLE_SQL[name], str(tmp_path))
    assert apply(awkward).count() == awkward.count()
    assert apply(empty).count() == 0


def test_licences_of_notices(spark):
    notices = {
        1: "Header\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        2: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        3: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        4: "we talk about licences, software and the public in general",
        5: "Creative Commons Attribution 4.0 International License: this work is licensed under a Creative Commons Attribution 4.0 International License",
    }
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(list(notices.items()), "doc_id long, text string")).collect()}
    assert got == {1: "apache-2.0", 2: "mit", 3: "gpl", 4: "", 5: "cc-by"}


def test_licences_of_a_long_collection(spark):
    collection = " ".join(words for _, _, words in license_scan.TEMPLATES)
    shares = {label for label, _, _ in license_scan.TEMPLATES}
    notices = ["licensed under cc by nc 4 0", "released under the mit license"]
    others = " ".join(w for label, _, words in license_scan.TEMPLATES if label not in ("mit", "cc-by-nc") for w in words.split()[::2])
    rows = [(1, collection), (None, f"{others} {notices[0]} and {others} {notices[1]}"), *((10 + k, text) for k, text in enumerate(notices * 20))]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got[1].labels.split(",")) == shares
    # The same by plain counting.
    for key, text in rows:
        words = re.findall("[a-z0-9]+", text)
        labels = set()
        for label, phrase, template in license_scan.TEMPLATES:
            own = [(w, k) for k, w in enumerate(template.split()) if w not in license_scan.COMMON]
            best = max(sum(0 <= at + k < len(words) and words[at + k] == w for w, k in own) for at in range(-len(template.split()), len(words)))
            if best >= 0.6 * len(own) and f" {phrase} " in f" {' '.join(words)} ":
                labels.add(label)
        base = {label for label, phrase in license_scan.BASE if f" {phrase} " in f" {' '.join(words)} "}
        assert got[key].labels == ",".join(sorted(labels | base))
    assert {"cc-by-nc", "mit"} <= set(got[None].labels.split(",")) and got[None].score == 1


def test_rules_plan_is_native(spark, awkward):
    for df in (quality_rules.apply_rules(awkward), quality_rules.kept_documents(awkward), license_scan.base_scan(awkward)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_rules_keep_columns_and_remove_lines(spark):
    prose = " ".join(f"word{k}" for k in range(60)) + "."
    rows = [(1, prose + "\nHome | News | Sport | Shop | More\nAccept cookies"), (2, "| a | b | c | d\n" * 40), (3, prose.replace(" ", "### "))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    assert [(r.doc_id, r.text, r.kept) for r in quality_rules.kept_documents(df).collect()] == [(1, rows[0][1], "clash")]
    assert quality_rules.apply_rules(df).where("doc_id = 1").first().clean_text == prose


# 7: byte-level BPE.


def test_bpe_as_tiktoken(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe(MULTI)
    texts = [t or "" for t in TEXTS] + _fuzz(1500, 4) + ["ab" * 2000, "é" * 400, " " * 700, "'" * 300]
    for t, ids in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t), t
        assert bpe.decode(ids) == t.encode() and bpe.offsets(ids)[-1] == len(t.encode())


def test_bpe_agrees_on_every_code_point():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe(MULTI)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 40_000):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}b " for c in codes[at : at + 40_000])
        assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text), hex(codes[at])


def test_bpe_slices():
    for t in _fuzz(60, 14) + ["", "a", "it's " * 9]:
        for chars in (1, 3, 7):
            assert [p for own in byte_bpe.slices_of(t, chars) for p in own] == byte_bpe.pieces_of([t])[0]
    bpe = byte_bpe.ByteBpe(MULTI)
    text = "some words and 漢字 of a long text, it's " * 60_000
    ids = bpe.encode(["a", text, "b"])
    assert bpe.decode(ids[1]) == text.encode() and (ids[0], ids[2]) == tuple(bpe.encode(["a", "b"]))


def test_scan_across_blocks():
    r = np.random.default_rng(8)
    classes = r.integers(0, 9, 5 * byte_bpe.BLOCK + 17).astype(np.uint8)
    state, wanted = byte_bpe.FRESH, []
    for c in classes:
        wanted.append(state)
        state = byte_bpe._AFTER[c, state]
    assert byte_bpe._states(classes).tolist() == wanted


def test_bpe_edges(spark, awkward, empty):
    got = byte_bpe.digests(awkward, MULTI).collect()
    texts = defaultdict(set)
    for k, t in _rows(awkward):
        texts[k].add(hashlib.sha256(t.encode()).hexdigest())
    assert len(got) == awkward.count() and all(r.decoded_sha256 in texts[r.doc_id] for r in got)
    assert byte_bpe.digests(empty, MULTI).count() == 0
    assert sum(r.n_bytes for r in got) == sum(len(t.encode()) for _, t in _rows(awkward))
    encoded = byte_bpe.encode_documents(awkward, MULTI)
    assert sorted(bytes(r.text) for r in byte_bpe.decode_documents(encoded, MULTI).collect()) == sorted(t.encode() for _, t in _rows(awkward))


def test_offsets_are_those_of_the_library():
    import tiktoken

    bpe = byte_bpe.ByteBpe(MULTI)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for t in [t or "" for t in TEXTS] + _fuzz(300, 8, ["é", "漢字", "🙂"]) + ["ab 漢 " * 60_000]:
        ids = bpe.encode([t])[0]
        offsets, data = bpe.offsets(ids), t.encode()
        text, chars = library.decode_with_offsets(np.frombuffer(ids, "<u4").tolist())
        assert text == t and bpe.decode(ids, offsets) == data == bpe.decode(ids)
        leads = np.concatenate([[0], np.cumsum([(b & 0xC0) != 0x80 for b in data])]).astype(int)
        assert [leads[o] - ((data[o] & 0xC0) == 0x80) for o in offsets[:-1]] == chars


# 8: packing.


def test_repeated_rows_are_spread(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 1000)
    rows = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(7).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    monkeypatch.setattr(packing, "staged", lambda df, label: taken.setdefault(label, common.staged(df, label)))
    packed = packing.pack(rows)
    pieces = taken["pieces"]
    assert pieces.groupBy(F.pmod(F.xxhash64("row"), F.lit(200)).alias("part")).count().agg(F.count("*"), F.max("count") < 1300).first() == (200, True)
    places = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("d")).collect()
    assert sum(r.n for r in places) == 200_000 and all(r.n == r.d <= 146 for r in places) and len(places) == -(-200_000 // 146)



def _check_packing(rows, size):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything(seed):
    r = np.random.default_rng(seed)
    size = int(r.choice([7, 64, 1024]))
    lengths = r.integers(1, size + 1, 3000) if seed % 2 else np.minimum(size, r.geometric(0.02, 3000))
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan, seen = packing.Plan(counts, size), set()
    fill = defaultdict(list)
    for length, n in counts.items():
        for s, o in zip(*map(np.ndarray.tolist, plan.place(np.full(n, length), np.arange(n)))):
            assert (s, o) not in seen
            seen.add((s, o))
            fill[s].append((o, length))
    for own in fill.values():
        at = 0
        for o, length in sorted(own):
            assert o == at
            at += length
        assert at <= size
    least = -(-int(lengths.sum()) // size)
    assert len(fill) == plan.sequences and plan.sequences <= max(least + 2, int(1.25 * least))
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    assert plan.sequences <= sum(n for _, n in packing.best_fit(count, size))


def test_sum_index_against_all_combinations():
    from itertools import combinations_with_replacement

    r = np.random.default_rng(5)
    for _ in range(30):
        count = np.zeros(31, np.int64)
        np.add.at(count, r.integers(1, 31, 8), 1)
        index = packing.SumIndex(count, 30)
        for length in r.integers(1, 30, 40).tolist():
            if not count[length]:
                continue
            total, besides = 30 - length, (length,)
            wanted = {k for k in (1, 2, 3) for own in combinations_with_replacement(range(1, 31), k) if sum(own) == total and all(count[x] >= (own + besides).count(x) for x in own)}
            found = index.making(total, besides)
            assert len(found) == min(wanted, default=0) and (not found or sum(found) == total)
            if found and r.random() < 0.3:
                for x in found:
                    count[x] -= 1


def test_exact_fills_use_singles_pairs_and_triples():
    count = np.zeros(101, np.int64)
    count[[100, 60, 40, 70, 25, 5, 80, 10, 7, 3]] = 1
    made = packing.exact_fills(count, 100)
    assert sorted(len(items) for items, _ in made) == [1, 2, 3, 4] and all(sum(items) == 100 for items, _ in made) and count.sum() == 0


def test_packing_edges(spark, awkward, empty):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(awkward, BYTES, size=64).collect()
    _check_packing(rows, 64)
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    wanted = []
    for k, t in _rows(awkward):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 64 + 1
        for p, stop in enumerate(range(first, len(ids) + 1, 64)):
            start = 0 if p == 0 else stop - 64
            wanted.append((k or -1, p, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    assert packing.pack_documents(empty, BYTES).count() == 0
    pieces = packing.cut_pieces(awkward, BYTES, size=64)
    for c in ("_part", "_n", "_rank", "_base", "part", "n", "rank", "base", "own"):
        pieces = pieces.withColumn(c, F.lit("clash"))
    assert _check_packing(packing.pack(pieces, size=64).where("base = 'clash'").collect(), 64) == _check_packing(rows, 64)


def test_op8_near_the_least(spark, sf_dir):
    rows = queries.op8_best_fit_packing(spark, sf_dir).collect()
    assert _check_packing(rows, 1024) <= 1.05 * -(-sum(r.length for r in rows) // 1024) + 1


# 9: page extraction.


@pytest.fixture(scope="module")
def field():
    return html_extract.train()


def test_pages_held_out(field):
    r, right, blocks = np.random.default_rng(12345), 0, 0
    for _ in range(150):
        page, labels = html_extract.labelled_page(r)
        got = field.main(html_extract.leaf_blocks(page))
        right, blocks = right + sum(a == b for a, b in zip(got, labels)), blocks + len(labels)
    assert right / blocks >= 0.97


def test_viterbi_is_the_best_labelling(field):
    from itertools import product

    r = np.random.default_rng(2)
    for _ in range(15):
        blocks = html_extract.leaf_blocks(html_extract.labelled_page(r)[0])[:9]
        unary = [field.bias + sum(field.weights.get(f, 0.0) for f in html_extract.features(b)) for b in blocks]

        def total(labels):
            return sum(u for u, y in zip(unary, labels) if y) + sum(field.pairs[int(a), int(b)] for a, b in zip(labels, labels[1:]))

        best = max(product([False, True], repeat=len(blocks)), key=total)
        assert total(field.main(blocks)) == pytest.approx(total(best))


def test_given_pages_give_their_articles(spark, sf_dir, field):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), field).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_long_lists_of_names(field):
    names = "col md lg row flex grow p m text box card wide"
    page = f"<div class='{names} sidebar'><p>One two three four five six.</p></div><article class='{names}'><h1>Title</h1><p>Words of the article that go on for a while, and on.</p></article><div class='{names} comments'><p>I say so too, and so do we.</p></div>"
    assert field.text(page) == "Title\nWords of the article that go on for a while, and on."


def test_markup():
    page = "<BODY><!-- <p>no --><p class=x>a &amp; b<b>c</b><br>d<p>e<script>var p='<p>x</p>'</script><ul><li>f<li>g</ul>h<textarea>no</textarea><img alt='>'>i</p><p>1 < 2 &lt; 3"
    assert [b[0] for b in html_extract.leaf_blocks(page)] == ["a & bc d", "e", "f", "g", "hi", "1 < 2 < 3"]
    for broken in ("<", "<p", "<!--", "<p class='", "</", "&", "<script>", "<a href=\"x>y", "a<b", "<" * 500, "<p>" * 3000):
        html_extract.leaf_blocks(broken)


def test_page_edges(spark, field):
    df = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<article><p>x y z w v.</p></article>"), (2, "u", "<article><p>x y z w v.</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df, field).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[:2] == [(0, 0), (1, 0)] and len(got) == 4
    assert html_extract.extract(df.where("false"), field).count() == 0


# 10: quotation linking.


def _plain_links(rows):
    """Brute force over (conv, turn, role, text) with distinct turns: position -> (reply_to, linked)."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        parsed = [quote_linking.parse(r[3] or "") for r in own]
        for at, (_, _, quoted, _) in enumerate(parsed):
            votes = defaultdict(int)
            for h in quoted:
                first = next((k for k, p in enumerate(parsed) if h in p[3]), None)
                if first is not None and first < at:
                    votes[first] += 1
            best = max(votes, key=lambda k: (votes[k], k)) if votes else (at - 1 if at else None)
            found[conv, at] = (best, sum(votes.values()))
    return found


def test_quotes(spark):
    r = random.Random(6)
    lines = ["How do I sort?", "Use sorted().", "Thanks!", "And in reverse?", "Pass reverse=True.", "Hello"]
    rows = []
    for conv in range(20):
        said = []
        for turn in range(r.randint(1, 8)):
            text = "\n".join(["> " * r.randint(1, 2) + (r.choice(said) if said else "?") for _ in range(r.randint(0, 3))] + r.sample(lines, r.randint(1, 2)))
            said += [x for x in text.split("\n") if not x.startswith(">")]
            rows.append((conv, turn, "user", text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.position): (x.reply_to, x.n_linked) for x in quote_linking.link_quotes(df).collect()}
    assert got == _plain_links(rows)
    for x in quote_linking.link_quotes(df).collect():
        assert ">" not in x.text and (x.reply_to is None or x.reply_to < x.position)


def test_quote_parsing():
    own, levels, quoted, said = quote_linking.parse("Hi\nOn Monday, Ann wrote:\n> > deep\n> Shallow,  text!\nbye")
    assert own == "Hi\nbye" and levels == 2 and len(quoted) == 2
    assert quote_linking.normalised_hash("shallow text") in quoted and quote_linking.normalised_hash("hi bye") in said


def test_nested_and_partial_quotes(spark):
    texts = [
        "First line here.\nSecond line here.\nThird line here.", "My answer is short.", "Another message. It has two sentences in one line.\n\nAnd a paragraph that\nis wrapped.",
        "> My answer is short.\n> > First line here.\n> > Second line here.\n> > Third line here.\nThanks", "Between", "> It has two sentences\n> in one line.\nYes", "Between again", "> And a paragraph\n> that is wrapped.\nNo",
    ]
    df = spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.position: r.reply_to for r in quote_linking.link_quotes(df, nested=True).collect()}
    assert (got[3], got[5], got[7]) == (1, 2, 2)


def test_quote_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, 1, None, "> x"), (2, None, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash")).withColumn("row", F.lit(1))
    got = quote_linking.link_quotes(df).collect()
    assert sorted((r.conv_id or 0, r.position) for r in got) == [(0, 0), (1, 0), (1, 1), (2, 0)]
    assert quote_linking.link_quotes(df.where("false")).count() == 0
    assert quote_linking.as_conversations(quote_linking.link_quotes(df)).count() == 3
    assert quote_linking.as_conversations(quote_linking.link_quotes(df.where("false"))).count() == 0


def _simple_thread(texts):
    """[(reply_to, own lines)] by rules of its own for messages of one-line quotes: no hashes, no regular expressions."""
    plain = lambda line: "".join(c for c in line.lower() if c.isalnum() or c == " ").split()
    own, found = [], []
    for at, text in enumerate(texts):
        levels, lines = defaultdict(list), []
        for line in text.split("\n"):
            depth = 0
            while line.startswith(">"):
                depth, line = depth + 1, line[1:].lstrip(" ")
            levels[depth].append(plain(line)) if depth else lines.append(line)
        reply = at - 1 if at else None
        for depth in sorted(levels):
            votes = defaultdict(int)
            for line in {tuple(x) for x in levels[depth] if x}:
                source = next((k for k in range(len(own)) if list(line) in [plain(x) for x in own[k]]), None)
                if source is not None:
                    votes[source] += 1
            if votes:
                reply = max(votes, key=lambda k: (votes[k], k))
                break
        own.append(lines)
        found.append((reply, "\n".join(lines)))
    return found


def _depth_first(replies):
    order, stack = [], [0] if replies else []
    while stack:
        at = stack.pop()
        order.append(at)
        stack += [k for k in reversed(range(len(replies))) if replies[k] == at]
    return order


def test_conversations_against_a_simple_thread(spark, monkeypatch):
    """Three quote levels, the same line said by several, answers to early messages, one conversation without id."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    r, rows, wanted = random.Random(12), [], {}
    for conv in [None, *range(12)]:
        texts = []
        for turn in range(r.choice([1, 3, 8, 30])):
            quoted = []
            for depth in range(1, r.randint(1, 4)):
                # Lines of messages that quote nothing, so that a passage of one level is one line.
                for line in r.sample([x for t in texts for x in t.split("\n") if not x.startswith(">")] or ["Never said."], 1):
                    quoted += ["> " * depth + line]
            texts.append("\n".join([*quoted, r.choice(["Yes", f"Message {turn} of {conv}", f"I think {turn % 3}"])]))
        rows += [(conv, turn, "user", t) for turn, t in enumerate(texts)]
        simple = _simple_thread(texts)
        wanted[conv] = [(at, simple[at][0], simple[at][1]) for at in _depth_first([x[0] for x in simple])]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for c in sorted(quote_linking.as_conversations(quote_linking.link_quotes(df, nested=True), most=7).collect(), key=lambda c: c.part):
        assert len(c.messages) == c.n_messages <= 7 and [m.place for m in c.messages] == list(range(7 * c.part, 7 * c.part + c.n_messages))
        got[c.conv_id] += [(m.position, m.reply_to, m.text) for m in c.messages]
    assert got == wanted


# The pipeline.


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in docs.collect()}
    columns = docs.columns
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir).cache()
        now = {r.doc_id for r in frame.collect()}
        assert frame.columns == columns and now <= kept and now, name
        kept = now
    rules = {r.doc_id for r in quality_rules.apply_rules(docs).where("kept").collect()}
    assert kept <= rules
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == kept
    _check_packing(rows, 1024)


def test_pipeline_of_nothing(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_pipeline_of_awkward_documents(spark, sf_dir, awkward):
    """Null ids and texts, repeated rows and clashing names pass every stage; one of repeated good rows stays, with its columns."""
    import corpus_pipeline

    good = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id").limit(30)
    extra = {c: F.lit("clash") for c in awkward.columns if c not in ("doc_id", "text")}
    few = good.withColumn("doc_id", F.col("doc_id") + 10_000).withColumns(extra)
    docs = common.staged(awkward.unionByName(few).unionByName(few).unionByName(few.withColumn("doc_id", F.lit(None).cast("long"))), "awkward-documents")
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame.count()
        frame = common.staged(stage(spark, frame, sf_dir), name)
        assert frame.columns == docs.columns and 0 < frame.count() <= before, name
    texts = [r.text for r in frame.select("text").collect()]
    assert len(set(texts)) == len(texts) and set(texts) <= {r.text for r in docs.select("text").collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).collect()
    assert len({(r.doc_id, r.piece, r.start, r.ids_crc32) for r in pieces}) == len(pieces) >= len(texts)


@pytest.mark.parametrize("name", ["token_shards", "license_scan", "quality_rules", "packing"])
def test_texts_of_many_megabytes(spark, name):
    """A text far longer than a block, beside a short one, gives what its parts give together."""
    line = "All rights reserved, says this line of words, under CC BY 4.0. "
    times = 60_000
    docs = spark.createDataFrame([(1, line * times), (2, line)], "doc_id long, text string")
    if name == "license_scan":
        got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
        assert got[1].n_words == times * got[2].n_words and got[1].n_base == times * got[2].n_base == 2 * times and got[1].labels == got[2].labels
    elif name == "quality_rules":
        got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
        assert got[1].word_chars == times * got[2].word_chars and got[1].n_repeat_words == got[1].n_words and got[1].base_failed
    elif name == "packing":
        rows = packing.pack_documents(docs, BYTES).collect()
        own = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
        assert all(r.length == 1024 for r in own[1:]) and [r.start for r in own[1:]] == [own[0].length + 1024 * k for k in range(len(own) - 1)]
    else:
        path = common.fresh_path(spark, "long-shards")
        token_shards.write_shards(docs, path, WORDS)
        got = {r.key: r for r in token_shards.shard_rows(token_shards.read_shards(spark, path)).collect()}
        assert got[2].start == got[1].n_tokens and got[1].n_tokens - 1 == times * (got[2].n_tokens - 1)
