"""Rolling k-gram hashes over arrays of words, as SQL expressions.

``let`` binds a value to a name inside one expression, so that a lambda refers to a value that is at hand and not
to an expression that would be evaluated for each element.
"""

from __future__ import annotations

#: A prime below 2^31: products of two residues fit a long.
PRIME = 2147483647
#: The base of the polynomial.
BASE = 1000003


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def polynomial(parts: list[str]) -> str:
    """(((p0 * B + p1) * B + p2) ...) mod PRIME."""
    out = parts[0]
    for p in parts[1:]:
        out = f"(({out}) * {BASE}L + {p}) % {PRIME}L"
    return out


def rolling(words: str, k: int) -> str:
    """Hashes (0 to PRIME - 1) of all runs of ``k`` words; fewer words make one gram, none make none.

    Each is the polynomial of its k word hashes. k is a constant, so this costs the same as subtracting the word
    that leaves and adding the one that enters, and needs no state from one position to the next.
    """
    one = polynomial([f"get(h, i + {j})" for j in range(k)])
    body = f"""case when size(h) = 0 then cast(array() as array<bigint>)
        when size(h) < {k} then array(aggregate(h, 0L, (s, x) -> (s * {BASE}L + x) % {PRIME}L))
        else transform(sequence(0, size(h) - {k}), i -> {one}) end"""
    return let("h", f"transform({words}, w -> pmod(xxhash64(w), {PRIME}L))", body)
