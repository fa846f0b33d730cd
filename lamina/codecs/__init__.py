"""Compression codecs as functions on bytes, with bounded output.

decode(data, **options) reads all frames of framed formats; of the others it reads one stream and
leaves what follows. Every decoder stops at max_output instead of allocating beyond it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..errors import LimitExceeded, MalformedData, Unsupported
from . import block, lz4, lzw, native, ppmd

DEFAULT_OUTPUT = 1 << 30


@dataclass(frozen=True)
class Codec:
    """One format: functions, other names, file extensions, and how many bytes detection looks at."""

    name: str
    encode: Callable[..., bytes]
    decode: Callable[..., tuple[bytes, int]]
    aliases: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    probe: int = 0
    framed: bool = False
    levels: tuple[int, int, int] | None = None  # least, most, default
    dictionary: bool = False


#: In catalog order, which decides ties of detection.
CATALOG = [
    Codec("bzip2", native.bzip2_encode, native.bzip2_decode, ("bz2",), ("bz2",), 4, True, (1, 9, 9)),
    Codec("compress", lzw.encode, lzw.decode, ("z", "unix-compress"), ("Z", "taz"), 3),
    Codec("deflate", native.deflate_encode, native.deflate_decode, levels=(0, 9, 6), dictionary=True),
    Codec("deflate64", block.deflate64_encode, block.deflate64_decode, levels=(0, 9, 6)),
    Codec("gzip", native.gzip_encode, native.gzip_decode, (), ("gz", "gzip"), 2, True, (0, 9, 6)),
    Codec("lz4", lz4.frame_encode, lz4.frame_decode, ("lz4-frame",), ("lz4",), 4, True, dictionary=True),
    Codec("lz4-block", lz4.block_encode, lz4.block_decode),
    Codec("lzip", native.lzip_encode, native.lzip_decode, (), ("lz", "tlz"), 4, True),
    Codec("lzma", native.lzma_encode, native.lzma_decode),
    Codec("lzma-raw", native.lzma_raw_encode, native.lzma_raw_decode),
    Codec("lzma2", native.lzma2_encode, native.lzma2_decode),
    Codec("ppmd", ppmd.encode, ppmd.decode, ("ppmd7",)),
    Codec("xz", native.xz_encode, native.xz_decode, (), ("xz", "txz"), 6, True),
    Codec("zlib", native.zlib_encode, native.zlib_decode, (), (), 2, levels=(0, 9, 6), dictionary=True),
    Codec("zstd", native.zstd_encode, native.zstd_decode, (), ("zst", "zstd"), 4, True, (-131072, 22, 3), True),
]
_BY_NAME = {n.lower(): c for c in CATALOG for n in (c.name, *c.aliases)}


def find(name: str) -> Codec | None:
    return _BY_NAME.get(name.lower())


def require(name: str) -> Codec:
    found = find(name)
    if found is None:
        raise Unsupported(f"no codec named {name}")
    return found


def encode(name: str, data: bytes, **options) -> bytes:
    return require(name).encode(data, **options)


def decode(name: str, data: bytes, max_output: int = DEFAULT_OUTPUT, **options) -> bytes:
    return require(name).decode(data, max_output=max_output, **options)[0]


def decode_frame(name: str, data: bytes, max_output: int = DEFAULT_OUTPUT, **options) -> tuple[bytes, int]:
    """The first frame and how many bytes it took."""
    codec = require(name)
    return codec.decode(data, max_output=max_output, **({"single": True} if codec.framed else {}), **options)


__all__ = ["CATALOG", "Codec", "LimitExceeded", "MalformedData", "Unsupported", "decode", "decode_frame", "encode", "find", "require"]
