"""Checksums on bytes that have no built-in Spark function."""

from __future__ import annotations

import hashlib
from functools import cache


@cache
def reflected_table(polynomial: int) -> list[int]:
    """Byte table of a reflected CRC."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (polynomial if i & 1 else 0)
        out.append(i)
    return out


def _reflected(data: bytes, polynomial: int, bits: int, start: int = 0) -> int:
    table, full = reflected_table(polynomial), (1 << bits) - 1
    x = start ^ full
    for b in data:
        x = x >> 8 ^ table[(x ^ b) & 255]
    return x ^ full


#: Polynomials, reflected where the CRC is.
CRC32C, CRC64_XZ, CRC32 = 0x82F63B78, 0xC96C5795D7870F42, 0x04C11DB7


def crc32c(data: bytes, start: int = 0) -> int:
    return _reflected(data, CRC32C, 32, start)


def crc64_xz(data: bytes, start: int = 0) -> int:
    return _reflected(data, CRC64_XZ, 64, start)


@cache
def _forward_table() -> list[int]:
    out = []
    for i in range(256):
        x = i << 24
        for _ in range(8):
            x = (x << 1 ^ (CRC32 if x >> 31 else 0)) & 0xFFFFFFFF
        out.append(x)
    return out


def crc32_bzip2(data: bytes) -> int:
    table, x = _forward_table(), 0xFFFFFFFF
    for b in data:
        x = (x << 8 ^ table[x >> 24 ^ b]) & 0xFFFFFFFF
    return x ^ 0xFFFFFFFF


def xxh32(data: bytes, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(data, seed)


def xxh64(data: bytes, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed)


def blake2sp(data: bytes) -> bytes:
    """Eight BLAKE2s leaves over interleaved 64-byte blocks, and a root over their digests."""
    leaves = [hashlib.blake2s(fanout=8, depth=2, node_offset=i, inner_size=32, last_node=i == 7) for i in range(8)]
    for i in range(0, len(data), 64):
        leaves[i // 64 % 8].update(data[i : i + 64])
    root = hashlib.blake2s(fanout=8, depth=2, node_depth=1, inner_size=32, last_node=True)
    for leaf in leaves:
        root.update(leaf.digest())
    return root.digest()


class Accumulator:
    """A checksum fed piece by piece; after finish() it keeps its value and takes nothing more."""

    def __init__(self, algorithm: str, seed: int = 0):
        import zlib

        import xxhash

        self.algorithm, self.seed = algorithm.upper().replace("-", ""), seed
        makers = {"SHA256": hashlib.sha256, "XXH32": lambda: xxhash.xxh32(seed=seed), "XXH64": lambda: xxhash.xxh64(seed=seed)}
        steps = {"CRC32": (0, lambda d, x: zlib.crc32(d, x), 4), "ADLER32": (1, lambda d, x: zlib.adler32(d, x), 4), "CRC32C": (0, lambda d, x: crc32c(d, x), 4), "CRC64XZ": (0, lambda d, x: crc64_xz(d, x), 8)}
        if self.algorithm in makers:
            self._make = makers[self.algorithm]
        elif self.algorithm in steps:
            self._start, self._step, self._width = steps[self.algorithm]
            self._make = None
        else:
            raise ValueError(f"no checksum named {algorithm}")
        self.reset()

    def reset(self) -> None:
        self._value = None
        self._state = self._make() if self._make else self._start

    def update(self, data: bytes) -> Accumulator:
        if self._value is not None:
            raise ValueError("finished")
        if self._make:
            self._state.update(data)
        else:
            self._state = self._step(data, self._state)
        return self

    def finish(self) -> bytes:
        """Big-endian bytes."""
        if self._value is None:
            self._value = self._state.digest() if self._make else self._state.to_bytes(self._width, "big")
        return self._value
