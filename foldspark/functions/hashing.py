"""32-bit hash functions on string and integer columns.  All results are longs in [0, 2**32)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# The constants of the published functions.
MURMUR2_M, MURMUR2_R, ENGINE_SEED = 0x5BD1E995, 24, 42
LOOKUP3_START = 0xDEADBEEF
LOOKUP3_MIX = (4, 6, 8, 16, 19, 4)
LOOKUP3_FINAL = (14, 11, 25, 16, 4, 14, 24)
FNV1_START, FNV1_PRIME = 0x811C9DC5, 0x01000193
FNV1_START_64, FNV1_PRIME_64 = 0xCBF29CE484222325, 0x100000001B3


def by_length(column: pa.Array, hash_block: Callable[[np.ndarray], list[np.ndarray]], width: int = 1) -> list[np.ndarray]:
    """``width`` hashes of each string: strings of one length are hashed together, as a matrix of bytes."""
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    starts, sizes = offsets[:-1], np.diff(offsets)
    out = [np.zeros(len(raw), np.int64) for _ in range(width)]
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        step = max(1, (1 << 24) // max(n, 1))  # bounds the matrix for long strings
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            block = data[starts[some][:, None] + np.arange(n)[None, :]] if n else np.zeros((len(some), 0), np.uint8)
            for k, h in enumerate(hash_block(block)):
                out[k][some] = h
    return out


def _words(block: np.ndarray, size: int) -> np.ndarray:
    """Little-endian 32-bit words of rows, padded with zeros to a multiple of ``size`` bytes."""
    pad = -block.shape[1] % size
    wide = np.ascontiguousarray(np.pad(block, ((0, 0), (0, pad))))
    return wide.view("<u4").reshape(len(block), -1)


def murmur2_block(block: np.ndarray, seed: int) -> np.ndarray:
    m, n = np.uint32(MURMUR2_M), block.shape[1]
    h = np.full(len(block), (seed ^ n) & MASK, np.uint32)
    words = _words(block, 4)
    for i in range(n // 4):
        k = words[:, i] * m
        k = (k ^ (k >> np.uint32(MURMUR2_R))) * m
        h = (h * m) ^ k
    if n % 4:
        h = (h ^ words[:, n // 4]) * m
    h = (h ^ (h >> np.uint32(13))) * m
    return h ^ (h >> np.uint32(15))


def _rotate(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint32(k)) | (x >> np.uint32(32 - k))


def lookup3_block(block: np.ndarray, seed1: int, seed2: int) -> list[np.ndarray]:
    """The primary and the secondary hash."""
    n = block.shape[1]
    s = [np.full(len(block), (LOOKUP3_START + n + seed1) & MASK, np.uint32) for _ in range(3)]
    s[2] = s[2] + np.uint32(seed2)
    if n:
        words = _words(block, 12)
        groups = words.shape[1] // 3
        for g in range(groups):
            for i in range(3):
                s[i] = s[i] + words[:, 3 * g + i]
            if g < groups - 1:
                for step, turn in enumerate(LOOKUP3_MIX):
                    x, y, z = step % 3, (step + 1) % 3, (step + 2) % 3
                    s[x] = (s[x] - s[z]) ^ _rotate(s[z], turn)
                    s[z] = s[z] + s[y]
        for step, turn in enumerate(LOOKUP3_FINAL):
            x, y = (2, 0, 1)[step % 3], (1, 2, 0)[step % 3]
            s[x] = (s[x] ^ s[y]) - _rotate(s[y], turn)
    return [s[2], s[1]]


def fnv1_block(block: np.ndarray, xor_first: bool = False, wide: bool = False) -> np.ndarray:
    kind = np.uint64 if wide else np.uint32
    start, prime = (FNV1_START_64, FNV1_PRIME_64) if wide else (FNV1_START, FNV1_PRIME)
    h = np.full(len(block), start, kind)
    with np.errstate(over="ignore"):
        for i in range(block.shape[1]):
            byte = block[:, i].astype(kind)
            h = (h ^ byte) * kind(prime) if xor_first else (h * kind(prime)) ^ byte
    return h.view(np.int64) if wide else h


def _string_udf(hash_block: Callable[[np.ndarray], list[np.ndarray]]):
    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        filled = column.fill_null("")
        return pa.array(by_length(filled, hash_block)[0], mask=column.is_null().to_numpy(zero_copy_only=False))

    return run


def murmur2(column: Column, seed: int = 0) -> Column:
    """MurmurHash2 of the UTF-8 bytes; null for null."""
    return _string_udf(lambda b: [murmur2_block(b, seed)])(column)


def engine_hash(column: Column) -> Column:
    """The hash that orders results: MurmurHash2 with seed 42, whose largest value is kept free."""
    h = murmur2(column, ENGINE_SEED)
    return F.when(h == MASK, F.lit(MASK - 1)).otherwise(h)


def bob(column: Column, seed: int = 0) -> Column:
    """Jenkins lookup3 of the UTF-8 bytes."""
    return _string_udf(lambda b: lookup3_block(b, seed, 0)[:1])(column)


def bob2(column: Column, seed1: int = 0, seed2: int = 0) -> Column:
    """Both lookup3 hashes as a struct (idx1, idx2)."""

    @F.arrow_udf("idx1 long, idx2 long")
    def run(strings: pa.Array) -> pa.Array:
        h = by_length(strings.fill_null(""), lambda b: lookup3_block(b, seed1, seed2), 2)
        null = strings.is_null()
        return pa.StructArray.from_arrays([pa.array(x) for x in h], ["idx1", "idx2"], mask=null)

    return run(column)


def fnv1(column: Column) -> Column:
    """FNV-1 (multiply, then xor) of the UTF-8 bytes."""
    return _string_udf(lambda b: [fnv1_block(b)])(column)


def fnv1a(column: Column) -> Column:
    """FNV-1a (xor, then multiply) of the UTF-8 bytes."""
    return _string_udf(lambda b: [fnv1_block(b, xor_first=True)])(column)


def fnv1_64(column: Column, xor_first: bool = False) -> Column:
    """FNV-1, or FNV-1a with ``xor_first``, of 64 bits, as a signed long."""
    return _string_udf(lambda b: [fnv1_block(b, xor_first, wide=True)])(column)


def hash_by(name: str, column: Column, seed: int = 0) -> Column:
    """A hash function by name: ``murmur`` or ``bob``."""
    return {"murmur": murmur2, "bob": bob}[name](column, seed)


def digram(column: Column) -> Column:
    """Hash of "first-second" whose neighbourhood is set by the longer word, so that related keys lie together.

    Text without a hyphen has its plain hash.
    """
    first = F.substring_index(column, "-", 1)
    second = F.substring(column, F.length(first) + 2, F.length(column))
    h1, h2 = murmur2(first, ENGINE_SEED), murmur2(second, ENGINE_SEED)
    near = F.lit(0x3FF)
    longer = F.octet_length(first) > F.octet_length(second)
    both = F.when(longer, h1 + h2.bitwiseAND(near)).otherwise(h1.bitwiseAND(near) + h2 + 1)
    wrapped = F.pmod(both, F.lit(MASK + 1))
    return F.when(~column.contains("-"), murmur2(column, ENGINE_SEED)).otherwise(F.when(wrapped == MASK, MASK - 1).otherwise(wrapped))


def nullhash(column: Column, shift: int) -> Column:
    """The 4 bytes that end ``shift`` bytes before the end, as a big-endian sum of signed bytes; 0 with fewer."""
    raw = column.cast("binary")
    size = F.octet_length(raw)
    part = F.substring(raw, size - shift - 3, F.lit(4))
    byte = lambda k: F.conv(F.hex(F.substring(part, F.lit(k), F.lit(1))), 16, 10).cast("long")
    signed = lambda b: F.when(b >= 128, b - 256).otherwise(b)
    total = sum((signed(byte(k)) * (1 << (32 - 8 * k)) for k in (2, 3, 4)), signed(byte(1)) * (1 << 24))
    return F.when(column.isNull(), F.lit(None)).when(size - shift < 4, F.lit(0)).otherwise(F.pmod(total, F.lit(MASK + 1))).cast("long")


def _u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def _chain(c: Column, steps: list) -> Column:
    """Steps (constant, operator, shift, operator): ``(a op constant) op (a shifted)``, masked each time."""
    a = _u32(c.cast("long"))
    for constant, inner, amount, outer in steps:
        left = _u32(a + constant) if inner == "+" else a.bitwiseXOR(F.lit(constant))
        moved = _u32(F.shiftleft(a, amount)) if amount > 0 else F.shiftright(a, -amount)
        a = _u32({"+": lambda x, y: x + y, "-": lambda x, y: x - y, "^": lambda x, y: x.bitwiseXOR(y)}[outer](left, moved))
    return a


# Constants and shifts (left positive) of the published integer hashes.
AVALANCHE_1 = [
    (0x7ED55D16, "+", 12, "+"),
    (0xC761C23C, "^", -19, "^"),
    (0x165667B1, "+", 5, "+"),
    (0xD3A2646C, "+", 9, "^"),
    (0xFD7046C5, "+", 3, "+"),
    (0xB55A4F09, "^", -16, "^"),
]
AVALANCHE_2 = [(0, "+", 6, "-"), (0, "+", -17, "^"), (0, "+", 9, "-"), (0, "+", 4, "^"), (0, "+", 3, "-"), (0, "+", 10, "^"), (0, "+", -15, "^")]
AVALANCHE_HALF = [
    (0x479AB41D, "+", 8, "+"),
    (0xE4AA10CE, "^", -5, "^"),
    (0x9942F0A6, "+", 14, "-"),
    (0x5AEDD67D, "^", -3, "^"),
    (0x17BEA992, "+", 7, "+"),
]


def hashint_1(c: Column) -> Column:
    """Full-avalanche integer hash with six shifts."""
    return _chain(c, AVALANCHE_1)


def hashint_2(c: Column) -> Column:
    """Full-avalanche integer hash with seven shifts."""
    return _chain(c, AVALANCHE_2)


def hashint_half(c: Column) -> Column:
    """Half-avalanche integer hash."""
    return _chain(c, AVALANCHE_HALF)
