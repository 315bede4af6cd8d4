"""Rule-based simplification of formulas, to a fixpoint; every rule is an identity of the logic."""

from __future__ import annotations

from .syntax import DEEPENING, Formula, fold, operator_counts, render, size, temporal_depth

T, F = "true", "false"


def complexity(f: Formula) -> tuple:
    text = render(f)
    return size(f), temporal_depth(f), len(text), text


def preference(f: Formula) -> tuple:
    text = render(f)
    return size(f), temporal_depth(f), sum(operator_counts(f).values()), len(text), text


def opposite(a: Formula, b: Formula) -> bool:
    return a == ("!", b) or b == ("!", a)


def _unary(op: str, x: Formula) -> Formula:
    if op == "!":
        flipped = {T: F, F: T}
        if x in flipped:
            return flipped[x]
        return x[1] if x[0] == "!" else (op, x)
    if x in (T, F):
        return x
    if op in "GF" and x[0] == op:
        return x
    if op in "GF" and x[0] == "X":
        return "X", (op, x[1])
    return op, x


def _conjunction(a, b):
    if F in (a, b) or opposite(a, b):
        return F
    if a == T or a == b:
        return b
    if b == T:
        return a
    for x, y in ((a, b), (b, a)):
        if y == ("F", x):
            return x
        if y == ("G", x):
            return y
    return None


def _disjunction(a, b):
    if T in (a, b) or opposite(a, b):
        return T
    if a == F or a == b:
        return b
    if b == F:
        return a
    for x, y in ((a, b), (b, a)):
        if y == ("F", x):
            return y
        if y == ("G", x):
            return x
    return None


def _implication(a, b):
    if a == F or b == T or a == b:
        return T
    if a == T:
        return b
    return ("!", a) if b == F else None


def _equivalence(a, b):
    if a == b:
        return T
    for x, y in ((a, b), (b, a)):
        if x == T:
            return y
        if x == F:
            return "!", y
    return None


def _until(a, b):
    if b in (T, F) or a == F or a == b:
        return b
    if a == T:
        return "F", b
    return b if b[0] == "F" and not isinstance(b, str) else None


def _release(a, b):
    if a == T or b in (T, F):
        return b
    return ("G", b) if a == F else None


def _weak_until(a, b):
    if T in (a, b):
        return T
    if a == F:
        return b
    return ("G", a) if b == F else None


_BINARY = {"&": _conjunction, "|": _disjunction, "->": _implication, "<->": _equivalence, "U": _until, "R": _release, "W": _weak_until}


def _two(op: str, a: Formula, b: Formula) -> Formula:
    found = _BINARY[op](a, b) if op in _BINARY else None
    if found is not None:
        return found
    if op in ("&", "|", "<->") and complexity(b) < complexity(a):
        a, b = b, a
    return op, a, b


def simplify(f: Formula) -> Formula:
    """Children first, again and again until nothing changes."""
    while True:
        g = fold(f, str, _unary, _two)
        if g == f:
            return f
        f = g


def without_weak_operators(f: Formula) -> Formula:
    """R, W and M written with U and G."""

    def two(op, a, b):
        if op == "W":
            return "|", ("U", a, b), ("G", a)
        if op == "R":
            return "|", ("U", b, ("&", a, b)), ("G", b)
        if op == "M":
            return "U", b, ("&", a, b)
        return op, a, b

    return fold(f, str, lambda op, x: (op, x), two)


def is_temporal(f: Formula) -> bool:
    return any(op in DEEPENING for op in operator_counts(f))


def selected(f: Formula) -> Formula:
    """The shorter of the formula and its simplified form (the formula itself if they are as long)."""
    return min(f, simplify(f), key=lambda g: len(render(g)))


def is_trivial(f: Formula) -> bool:
    g = selected(f)
    return isinstance(g, str) or g[0] == "!" and isinstance(g[1], str) or not is_temporal(g) and size(g) <= 3


def looks_unsatisfiable(f: Formula, compatible: bool = False) -> bool:
    """Contradictions that show in the syntax. compatible: any flagged part flags the whole, as older runs had it."""
    if isinstance(f, str):
        return f == F
    if len(f) == 2:
        return looks_unsatisfiable(f[1], compatible) and (compatible or f[0] != "!")
    a, b = f[1:]
    flagged = [looks_unsatisfiable(x, compatible) for x in (a, b)]
    if f[0] == "&" and (opposite(a, b) or a[0] == b[0] == "G" and opposite(a[1], b[1])):
        return True
    if compatible or f[0] == "&":
        return any(flagged)
    return f[0] == "|" and all(flagged)
