"""Covering masks for SimHash fingerprints of 64 bits.

Each bit has a nonzero vector of radius + 1 bits. A table stands for a nonzero
vector v; its mask keeps the bits whose vector has an odd product with v. The
vectors of `radius` differing bits span less than the space, so some v is
orthogonal to all of them: under its mask both fingerprints keep the same bits.
So every pair within the radius agrees in some table, by construction and not by
chance.
"""

from __future__ import annotations

RADIUS = 3


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks: bit i has the vector 1 + i mod (2**(radius + 1) - 1)."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, p in enumerate(vectors) if bin(p & v).count("1") % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
