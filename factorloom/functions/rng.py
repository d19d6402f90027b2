"""Counter-based 64-bit hash of (seed, i, j), as a Column expression and as a numpy twin.

The mask of a cross-validation and the start of a factorization are functions of ids alone, so nothing is
stored and any partitioning gives the same. Sums wrap at 64 bits; Spark's ANSI mode forbids that,
hence the two 32-bit halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def _long(x) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(int(x)).cast("long")


def _left(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftleft(x, n))


def _right(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, n))


def _add(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def _bound(x: Column, f) -> Column:
    """f(x) with x evaluated once: each mixing step names its argument twice, and the plan would double with each."""
    return F.get(F.transform(F.array(x), f), 0)


def hash64(seed, i, j) -> Column:
    """The hash as a signed long."""
    seed = _long(seed)
    x = _bound(_left(_long(i), 19), lambda x: _left(_right(x, 7), 36))
    x = _bound(_add(seed, x), lambda x: _right(_left(x, 38), 13))
    j = _bound(_right(_long(j), 7), lambda x: _right(_left(x, 23), 8))
    x = _bound(x, lambda x: _add(_left(x, 23), j))
    x = _bound(x, lambda x: _left(_right(x, 7), 53))
    return _bound(x, lambda x: _right(x, 4))


def sample_class(seed, i, bits: int) -> Column:
    """The low bits of left_np."""
    x = _bound(_left(_long(i), 19), lambda x: _left(_right(x, 7), 36))
    x = _bound(_add(_long(seed), x), lambda x: _right(_left(x, 38), 13))
    return _left(x, 23).bitwiseAND(F.lit((1 << bits) - 1))


def unsigned_mod(x: Column, p: int) -> Column:
    """x mod p with x read as unsigned; p below 2**31."""
    return _bound(x, lambda x: _mod(x, p))


def _mod(x: Column, p: int) -> Column:
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    return ((high % p) * F.lit((1 << 32) % p).cast("long") + low % p) % p


def masked(seed, i, j, inverse_density: int) -> Column:
    return unsigned_mod(hash64(seed, i, j), inverse_density) == 0


def uniform(seed, i, j) -> Column:
    """In [0, 1]: the unsigned hash over 2**64."""
    share = lambda x: (F.shiftrightunsigned(x, 32).cast("double") * 4294967296.0 + x.bitwiseAND(F.lit(_LOW)).cast("double")) / 18446744073709551616.0
    return _bound(hash64(seed, i, j), share)


def left_np(seed: int, i) -> np.ndarray:
    """What i adds to the hash before it is mixed; right_np is what j adds."""
    s = np.uint64
    i = np.asarray(i).astype(np.uint64)
    i = i ^ (i << s(19))
    i = i ^ (i >> s(7))
    i = i ^ (i << s(36))
    x = s(seed & ((1 << 64) - 1)) + i
    x = x ^ (x << s(38))
    x = x ^ (x >> s(13))
    return x ^ (x << s(23))


def right_np(j) -> np.ndarray:
    s = np.uint64
    j = np.asarray(j).astype(np.uint64)
    j = j ^ (j >> s(7))
    j = j ^ (j << s(23))
    return j ^ (j >> s(8))


def mix_np(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """The hash of a sum of left_np and right_np, in place; spare is of the same shape."""
    spare = np.empty_like(x) if spare is None else spare
    for shift, n in ((np.right_shift, 7), (np.left_shift, 53), (np.right_shift, 4)):
        shift(x, np.uint64(n), out=spare)
        np.bitwise_xor(x, spare, out=x)
    return x


def hash64_np(seed: int, i, j) -> np.ndarray:
    return mix_np(np.atleast_1d(left_np(seed, i) + right_np(j))).reshape(np.broadcast_shapes(np.shape(i), np.shape(j)))


#: Others from which on masked_blocks sorts by class, and cells of a block.
CLASSED, BLOCK = 1 << 15, 1 << 16


def class_bits(inverse_density: int) -> int:
    """Low bits of the unmixed sum that tell whether the hash can be divided by the power of two (8 at most) in inverse_density."""
    even = min(3, (inverse_density & -inverse_density).bit_length() - 1)
    return even + 11 if even else 0


def masked_blocks(seed: int, inverse_density: int, by_sample: bool, own: np.ndarray, other: np.ndarray, classed: int = CLASSED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Which pairs are masked, as blocks (places in own, places in other, hits [own][other]); each pair is in one block at most, a masked one in one.

    With many others, pairs of classes (low bits) whose hashes can't be even enough are not looked at: for a density of 1 in 20 these are 3 of 4.
    """
    a, b = (left_np(seed, own), right_np(other)) if by_sample else (right_np(own), left_np(seed, other))
    bits = class_bits(inverse_density) if len(other) >= classed else 0
    low = np.uint64((1 << bits) - 1)
    even = max(0, bits - 11)
    odd = inverse_density >> even
    by_class, b_order = np.argsort(a & low, kind="stable"), np.argsort(b & low, kind="stable")
    b = b[b_order]
    classes, first = np.unique((a & low)[by_class], return_index=True)
    sizes = np.bincount((b & low).astype(np.int64), minlength=1 << bits)
    able = mix_np(np.arange(1 << bits, dtype=np.uint64)) & np.uint64((1 << even) - 1) == 0
    places = np.arange(1 << bits)
    inverse, most = np.uint64(pow(odd, -1, 1 << 64) if odd & 1 else 0), np.uint64(((1 << 64) - 1) // odd)
    x, spare = np.empty(BLOCK, np.uint64), np.empty(BLOCK, np.uint64)
    for c, lo, hi in zip(classes.tolist(), first.tolist(), [*first[1:].tolist(), len(a)]):
        some, places_b = (b, b_order) if not bits else (b[keep := np.repeat(able[(places + c) & ((1 << bits) - 1)], sizes)], b_order[keep])
        high = max(1, min(hi - lo, BLOCK // max(1, min(len(some), 1 << 9))))
        wide = BLOCK // high
        for at in range(lo, hi, high):
            rows = by_class[at : min(at + high, hi)]
            for left in range(0, len(some), wide):
                part = some[left : left + wide]
                shape = len(rows), len(part)
                z, t = (v[: shape[0] * shape[1]].reshape(shape) for v in (x, spare))
                mix_np(np.add(a[rows][:, None], part[None, :], out=z), t)
                hit = np.multiply(z, inverse, out=t) <= most if odd & 1 else z % np.uint64(odd << even) == 0
                yield rows, places_b[left : left + wide], hit


def masked_np(seed: int, i, j, inverse_density: int) -> np.ndarray:
    return hash64_np(seed, i, j) % np.uint64(inverse_density) == 0


def uniform_np(seed: int, i, j) -> np.ndarray:
    return hash64_np(seed, i, j).astype(np.float64) / 2.0**64
