"""Distinct variants of records: numbers of k-permutations, drawn without repeats and turned into names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

_MASK = (1 << 64) - 1
#: Rounds of the keyed walk over permutation numbers.
ROUNDS = 4


def _mixed(x: int) -> int:
    """A 64-bit number with its bits well spread (the finalizer of splitmix64)."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def drawn_numbers(key: int, below: int) -> Iterator[int]:
    """All numbers below ``below``, each once, in an order that the key decides.

    A Feistel network permutes the smallest square power of two that holds them; numbers beyond are walked on.
    """
    half = max(1, ((below - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    for x in range(below):
        while True:
            a, b = x >> half, x & low
            for r in range(ROUNDS):
                a, b = b, a ^ (_mixed((b & _MASK) * ROUNDS + r + key & _MASK) & low if half <= 64 else _wide(key, r, b, half))
            x = a << half | b
            if x < below:
                break
        yield x


def _wide(key: int, r: int, b: int, half: int) -> int:
    """As many mixed bits as half a number of over 128 bits has."""
    found = 0
    for word in range(0, half, 64):
        found = found << 64 | _mixed(_mixed((b >> word) & _MASK) + key + r * 64 + word & _MASK) ^ found & _MASK
    return found & ((1 << half) - 1)


def unranked(number: int, m: int, k: int) -> list[int]:
    """The k-permutation of range(m) with this number, by the factorial number system."""
    left, found = list(range(m)), []
    for j in range(k):
        block = math.perm(m - j - 1, k - j - 1)
        at, number = divmod(number, block)
        found.append(left.pop(at))
    return found


def draws(key: Column, k: Column, names: list[str], n: int) -> Column:
    """Lists of k distinct names: min(n, P(m, k)) different ones, in an order that the key decides."""
    m = len(names)

    def drawn(keys: pa.Array, sizes: pa.Array) -> pa.Array:
        found = []
        for own, size in zip(keys.to_pylist(), sizes.to_pylist()):
            numbers = drawn_numbers(own & _MASK, math.perm(m, size)) if size <= m else iter(())
            found.append([[names[at] for at in unranked(x, m, size)] for _, x in zip(range(n), numbers)])
        return pa.array(found, pa.list_(pa.list_(pa.string())))

    return F.arrow_udf(drawn, "array<array<string>>")(key, k)


def grounded_variants(df: DataFrame, names: list[str], variants: int = 2, fields: tuple[str, ...] = ("LTL",), seed: int = 0) -> DataFrame:
    """Variants of each template with its placeholders replaced by distinct names, drawn from the record's id.

    A template with k placeholders has min(variants, P(m, k)) different ones for m distinct names. Templates with as many placeholders
    as names, or more, have none; those without placeholders come once, as they are. Draws follow from
    (seed, id), so a repeated task draws alike. Adds ap_mapping and template_id (null where nothing is replaced).
    """
    names = list(dict.fromkeys(names))
    own = tx.placeholders(*(F.col(f"`{f}`") for f in fields))
    found = df.withColumn("_props", own).where(F.size("_props") < len(names))
    # The number of placeholders alone goes to Python, and a key.
    drawn = found.withColumn("_draws", draws(F.xxhash64(F.lit(seed), F.col("id")), F.size("_props"), names, variants))
    made = drawn.withColumn("_draw", F.explode(F.when(F.size("_props") == 0, F.array(F.array().cast("array<string>"))).otherwise(F.col("_draws"))))
    replaced = {f: tx.replaced_names(F.col(f"`{f}`"), F.col("ap_mapping")) for f in fields}
    named = made.withColumn("ap_mapping", F.map_from_arrays("_props", "_draw")).withColumn("template_id", F.when(F.size("_props") > 0, F.col("id")))
    return named.withColumns(replaced).drop("_props", "_draw", "_draws")
