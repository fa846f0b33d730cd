"""RAR archives for queries and tests. The format has no free writer, so bodies are stored, or literals in a flat
code, which readers must unpack like any other body."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _vint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bits(values, width: int) -> np.ndarray:
    """Numbers as bits, the highest first."""
    v = np.asarray(values, dtype=np.uint32)
    return (v[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint32) & 1).astype(np.uint8).ravel()


def _flat(sizes: list[tuple[int, int]]) -> list[np.ndarray]:
    """Code lengths (how many, length), in a code of five bits for each length."""
    return [_bits([5] * 20, 4), *[_bits([length] * many, 5) for many, length in sizes]]


def flat_five(body: bytes) -> bytes:
    """A RAR 5 body of one block: nine bits for each literal."""
    bits = np.concatenate([*_flat([(306, 9), (64, 6), (16, 4), (44, 6)]), _bits(np.frombuffer(body, np.uint8), 9)])
    data = np.packbits(bits).tobytes()
    flags = 0x80 | 0x40 | 2 << 3 | (len(bits) - 1) % 8
    size = len(data).to_bytes(3, "little")
    return bytes([flags, 0x5A ^ flags ^ size[0] ^ size[1] ^ size[2]]) + size + data


def flat_four(body: bytes) -> bytes:
    """A RAR 2.9 body of one block: nine bits for each literal, then the end mark."""
    end = [_bits([256], 9), _bits([0, 1], 1)]
    bits = [_bits([0, 0], 1), *_flat([(299, 9), (60, 6), (17, 5), (28, 5)]), _bits(np.frombuffer(body, np.uint8), 9), *end]
    return np.packbits(np.concatenate(bits)).tobytes()


def five(entries, packed: bool) -> bytes:
    """entries: (path, body)."""

    def block(kind: int, fields: bytes, data: bytes | None = None) -> bytes:
        head = _vint(kind) + _vint(0 if data is None else 2) + (b"" if data is None else _vint(len(data))) + fields
        head = _vint(len(head)) + head
        return zlib.crc32(head).to_bytes(4, "little") + head + (data or b"")

    out = [b"Rar!\x1a\x07\x01\x00", block(1, _vint(0))]
    for path, body in entries:
        name, method = path.encode(), 3 if packed and body else 0
        fields = _vint(4) + _vint(len(body)) + _vint(0o100640) + zlib.crc32(body).to_bytes(4, "little") + _vint(method << 7 | 3 << 10) + _vint(1) + _vint(len(name)) + name
        out.append(block(2, fields, flat_five(body) if method else body))
    return b"".join([*out, block(5, _vint(0))])


def four(entries, packed: bool) -> bytes:
    def block(kind: int, flags: int, fields: bytes) -> bytes:
        head = bytes([kind]) + flags.to_bytes(2, "little") + (7 + len(fields)).to_bytes(2, "little") + fields
        return (zlib.crc32(head) & 0xFFFF).to_bytes(2, "little") + head

    out = [b"Rar!\x1a\x07\x00", block(0x73, 0, bytes(6))]
    for path, body in entries:
        name, method = path.encode(), 0x33 if packed and body else 0x30
        data = flat_four(body) if method == 0x33 else body
        small = lambda *values: b"".join(v.to_bytes(4, "little") for v in values)
        out += [block(0x74, 0x8000, small(len(data), len(body)) + b"\x03" + small(zlib.crc32(body), 0x21 << 16) + bytes([29, method]) + len(name).to_bytes(2, "little") + small(0o100640) + name), data]
    return b"".join([*out, block(0x7B, 0x4000, b"")])


def archived(entries: DataFrame, version: int, packed: bool) -> DataFrame:
    """(archive, content) from (archive, path, body): an archive per value of `archive`."""
    make = {4: four, 5: five}[version]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("path")
        return pd.DataFrame({"archive": part["archive"].iloc[:1].to_numpy(), "content": [make(zip(part["path"], map(bytes, part["body"])), packed)]})

    kind = entries.schema["archive"].dataType.simpleString()
    return entries.select("archive", "path", "body").groupBy("archive").applyInPandas(one, f"archive {kind}, content binary")
