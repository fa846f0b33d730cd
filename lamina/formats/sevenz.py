"""7z: plain, encoded and encrypted headers, folders of coders with BCJ2, solid blocks; a writer."""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

from .. import codecs
from ..errors import LimitExceeded, MalformedData, Unsupported
from ..functions import crypto, transforms
from .entry import DIRECTORY, FILE, SYMLINK, Entry, Limits, Tracker, exactly, mode_of_type, safe_path, secret_of, type_of_mode, windows_time

MAGIC = b"7z\xbc\xaf\x27\x1c"
#: Coder ids.
CODERS = {
    "copy": b"\x00", "lzma": b"\x03\x01\x01", "lzma2": b"\x21", "bzip2": b"\x04\x02\x02", "deflate": b"\x04\x01\x08", "deflate64": b"\x04\x01\x09", "zstd": b"\x04\xf7\x11\x01", "ppmd": b"\x03\x04\x01", "aes": b"\x06\xf1\x07\x01",
    "delta": b"\x03", "x86": b"\x03\x03\x01\x03", "bcj2": b"\x03\x03\x01\x1b", "ppc": b"\x03\x03\x02\x05", "ia64": b"\x03\x03\x04\x01", "arm": b"\x03\x03\x05\x01", "thumb": b"\x03\x03\x07\x01", "sparc": b"\x03\x03\x08\x05", "arm64": b"\x0a", "riscv": b"\x0b",
}
NAMES = {v: k for k, v in CODERS.items()}
END, HEADER, ARCHIVE, EXTRA, MAIN, FILES, PACK, UNPACK, SUB, SIZE, CRC, FOLDER, UNPACK_SIZE, COUNT, EMPTY, EMPTY_FILE, ANTI, NAME, CTIME, ATIME, MTIME, ATTRIBUTES, COMMENT, ENCODED = range(24)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if n < 0 or len(part) != n:
            raise MalformedData("truncated header")
        self.at += n
        return part

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        first, value, mask = self.byte(), 0, 0x80
        for i in range(8):
            if not first & mask:
                return value | (first & mask - 1) << 8 * i
            value |= self.byte() << 8 * i
            mask >>= 1
        return value

    def count(self) -> int:
        n = self.number()
        if n > len(self.data) * 8 + 64:
            raise MalformedData("count beyond the header")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.take(-(-n // 8))
        return [bool(raw[i // 8] & 0x80 >> i % 8) for i in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def digests(self, n: int) -> list[int | None]:
        return [int.from_bytes(self.take(4), "little") if d else None for d in self.defined(n)]


class Folder:
    """Coders (name, inputs, outputs, properties), pairs (input, output), packed inputs, sizes of outputs."""

    def __init__(self, r: Reader):
        self.coders = []
        for _ in range(r.count()):
            flags = r.byte()
            if flags & 0xC0:
                raise MalformedData("coder flags")
            ident = r.take(flags & 15)
            if ident not in NAMES:
                raise Unsupported(f"coder {ident.hex()}")
            n_in, n_out = (r.count(), r.count()) if flags & 16 else (1, 1)
            if n_out != 1:
                raise Unsupported("coder with several outputs")
            self.coders.append((NAMES[ident], n_in, n_out, r.take(r.count()) if flags & 32 else b""))
        n_in, n_out = sum(c[1] for c in self.coders), len(self.coders)
        self.pairs = dict((r.number(), r.number()) for _ in range(n_out - 1))
        free = n_in - len(self.pairs)
        self.packed = [next(i for i in range(n_in) if i not in self.pairs)] if free == 1 else [r.number() for _ in range(free)]
        self.sizes: list[int] = []
        self.crc: int | None = None

    def last(self) -> int:
        used = set(self.pairs.values())
        return next(i for i in range(len(self.coders)) if i not in used)

    def size(self) -> int:
        return self.sizes[self.last()]


class Streams:
    def __init__(self):
        self.at, self.packs, self.pack_crcs, self.folders, self.counts, self.sizes, self.crcs = 0, [], [], [], [], [], []


def _streams(r: Reader) -> Streams:
    s = Streams()
    kind = r.number()
    if kind == PACK:
        s.at, n = r.number(), r.count()
        while (k := r.number()) != END:
            if k == SIZE:
                s.packs = [r.number() for _ in range(n)]
            elif k == CRC:
                s.pack_crcs = r.digests(n)
            else:
                raise MalformedData("pack information")
        kind = r.number()
    if kind == UNPACK:
        if r.number() != FOLDER:
            raise MalformedData("folders")
        n = r.count()
        if r.byte():
            raise Unsupported("external folders")
        s.folders = [Folder(r) for _ in range(n)]
        if r.number() != UNPACK_SIZE:
            raise MalformedData("folder sizes")
        for f in s.folders:
            f.sizes = [r.number() for _ in f.coders]
        while (k := r.number()) != END:
            if k != CRC:
                raise MalformedData("folder information")
            for f, crc in zip(s.folders, r.digests(n)):
                f.crc = crc
        kind = r.number()
    if sum(len(f.packed) for f in s.folders) != len(s.packs) and s.folders:
        raise MalformedData("pack streams")
    s.counts = [1] * len(s.folders)
    sizes_read = False
    if kind == SUB:
        k = r.number()
        if k == COUNT:
            s.counts = [r.count() for _ in s.folders]
            k = r.number()
        for f, c in zip(s.folders, s.counts):
            if c:
                some = [r.number() for _ in range(c - 1)] if k == SIZE else []
                if c > 1 and k != SIZE:
                    raise MalformedData("substream sizes")
                rest = f.size() - sum(some)
                if rest < 0:
                    raise MalformedData("substream sizes")
                s.sizes += [*some, rest]
        sizes_read = True
        if k == SIZE:
            k = r.number()
        missing = [i for f, c in zip(s.folders, s.counts) for i in range(c) if not (c == 1 and f.crc is not None)]
        found = iter([None] * len(missing))
        while k != END:
            if k != CRC:
                raise MalformedData("substreams")
            found = iter(r.digests(len(missing)))
            k = r.number()
        for f, c in zip(s.folders, s.counts):
            s.crcs += [f.crc] if c == 1 and f.crc is not None else [next(found, None) for _ in range(c)]
        kind = r.number()
    if not sizes_read:
        s.sizes, s.crcs = [f.size() for f in s.folders], [f.crc for f in s.folders]
    if kind != END:
        raise MalformedData("streams")
    return s


def _lzma_properties(raw: bytes) -> dict:
    if len(raw) < 5:
        raise MalformedData("LZMA properties")
    return {"lc": raw[0] % 9, "lp": raw[0] // 9 % 5, "pb": raw[0] // 45, "dict_size": int.from_bytes(raw[1:5], "little")}


def _decoded(name: str, props: bytes, data: bytes, size: int, password: str | None) -> bytes:
    if name == "copy":
        return data[:size]
    if name == "lzma":
        return codecs.decode("lzma-raw", data, max_output=size, decoded_size=size, **_lzma_properties(props))
    if name == "lzma2":
        d = props[0] if props else 40
        return codecs.decode("lzma2", data, max_output=size, dict_size=min(1 << 30, (2 | d & 1) << d // 2 + 11))
    if name in ("bzip2", "deflate", "deflate64", "zstd"):
        return codecs.decode(name, data, max_output=size)
    if name == "ppmd":
        if len(props) < 5 or not 2 <= props[0] <= 64:
            raise MalformedData("PPMd properties")
        return codecs.decode("ppmd", data, max_output=size, decoded_size=size, order=props[0], memory=int.from_bytes(props[1:5], "little"))
    if name == "delta":
        return transforms.delta_decode(data, (props[0] if props else 0) + 1)
    if name in transforms.BRANCHES:
        return transforms.BRANCHES[name](data, False)
    if name == "aes":
        if password is None:
            raise Unsupported("a password is needed")
        first, second = props[0], props[1] if len(props) > 1 else 0
        n_salt, n_iv = (first >> 7) + (second >> 4), (first >> 6 & 1) + (second & 15)
        salt, iv = props[2 : 2 + n_salt], props[2 + n_salt : 2 + n_salt + n_iv]
        return crypto.cbc_decrypt(crypto.sevenzip_key(password, salt, first & 63), iv.ljust(16, b"\0"), data)[:size]
    raise Unsupported(f"coder {name}")


def _folder(f, base: int, folder: Folder, offsets: list[int], packs: list[int], password: str | None, limits: Limits) -> bytes:
    """The folder's last output, from its packed inputs."""
    first_in = [sum(c[1] for c in folder.coders[:i]) for i in range(len(folder.coders))]
    if any(n > limits.output() for n in folder.sizes):
        raise LimitExceeded("entry_size", limits.output(), max(folder.sizes))

    def stream(i: int, depth: int = 0) -> bytes:
        if depth > 32:
            raise MalformedData("coders in a circle")
        if i in folder.pairs:
            return output(folder.pairs[i], depth + 1)
        k = folder.packed.index(i)
        f.seek(base + offsets[k])
        return exactly(f, packs[k])

    def output(i: int, depth: int = 0) -> bytes:
        name, n_in, _, props = folder.coders[i]
        size = folder.sizes[i]
        if name == "bcj2":
            if n_in != 4:
                raise MalformedData("BCJ2 has four inputs")
            out = transforms.bcj2_merge(*(stream(first_in[i] + k, depth) for k in range(4)), size)
        elif n_in != 1:
            raise Unsupported("coder with several inputs")
        else:
            out = _decoded(name, props, stream(first_in[i], depth), size, password)
        if len(out) != size:
            raise MalformedData("coder output size")
        return out

    data = output(folder.last())
    if folder.crc is not None and zlib.crc32(data) != folder.crc:
        raise MalformedData("folder checksum")
    return data


@dataclass
class Body:
    """A stream in what a folder decodes to; offsets and packs are the places and sizes of the folder's packed inputs."""

    path: str
    number: int
    folder: Folder
    offsets: list[int]
    packs: list[int]
    at: int
    size: int
    crc: int | None
    decoded: Callable[[Body], bytes] | None

    def __call__(self) -> bytes:
        data = self.decoded(self)[self.at : self.at + self.size]
        if self.crc is not None and zlib.crc32(data) != self.crc:
            raise MalformedData(f"checksum of {self.path}")
        return data


@dataclass
class Part:
    """A folder cut out of its archive, to be decoded elsewhere: the ordinal of its first entry, its entries and
    empty ones among them, the packed inputs."""

    first: int
    entries: list[Entry] = field(default_factory=list)
    number: int | None = None
    packed: bytes = b""

    def read(self, limits: Limits = Limits(), password=None) -> Iterator[tuple[int, Entry]]:
        """Entries with their ordinals, to be read in order or not: the folder is decoded once."""
        data: list[bytes] = []

        def decoded(b: Body) -> bytes:
            if not data:
                at = [sum(b.packs[:i]) for i in range(len(b.packs))]
                data.append(_folder(io.BytesIO(self.packed), 0, b.folder, at, b.packs, _secret(password), limits))
            return data[0]

        for i, e in enumerate(self.entries):
            yield self.first + i, replace(e, body=replace(e.body, decoded=decoded)) if isinstance(e.body, Body) else e


def parts(f, limits: Limits = Limits(), password=None) -> Iterator[Part]:
    """The archive folder by folder, from its header and the packed bytes alone."""
    held = Part(0)
    for i, e in enumerate(read(f, limits, password)):
        if isinstance(b := e.body, Body):
            if held.number not in (None, b.number):
                yield held
                held = Part(i)
            if held.number is None:
                held.number, packs = b.number, []
                for at, n in zip(b.offsets, b.packs):
                    f.seek(at)
                    packs.append(exactly(f, n))
                held.packed = b"".join(packs)
            e = replace(e, body=replace(b, decoded=None))
        held.entries.append(e)
    if held.entries:
        yield held


def _secret(password) -> str | None:
    password = secret_of(password, None)
    return password.decode() if isinstance(password, bytes) else password


def read(f, limits: Limits = Limits(), password=None, **_):
    tracker, password = Tracker(limits), _secret(password)
    f.seek(0)
    head = exactly(f, 32)
    if head[:6] != MAGIC:
        raise MalformedData("not a 7z archive")
    if zlib.crc32(head[12:32]) != int.from_bytes(head[8:12], "little"):
        raise MalformedData("start header checksum")
    offset, size, crc = struct.unpack_from("<QQI", head, 12)
    if not size:
        return
    f.seek(0, 2)
    if 32 + offset + size > f.tell():
        raise MalformedData("truncated archive")
    tracker.header(size)
    f.seek(32 + offset)
    raw = exactly(f, size)
    if zlib.crc32(raw) != crc:
        raise MalformedData("header checksum")
    for _ in range(8):
        r = Reader(raw)
        kind = r.number()
        if kind == END:
            return
        if kind == HEADER:
            break
        if kind != ENCODED:
            raise MalformedData("header")
        s, parts, k = _streams(r), [], 0
        for folder in s.folders:
            n = len(folder.packed)
            at = [32 + s.at + sum(s.packs[: k + i]) for i in range(n)]
            parts.append(_folder(f, 0, folder, at, s.packs[k : k + n], password, limits))
            k += n
        raw = b"".join(parts)
        tracker.header(len(raw))
    else:
        raise MalformedData("headers in headers")
    yield from _entries(f, r, tracker, limits, password)


def _entries(f, r: Reader, tracker: Tracker, limits: Limits, password: str | None):
    s = Streams()
    kind = r.number()
    if kind == ARCHIVE:
        while r.number() != END:
            r.take(r.count())
        kind = r.number()
    if kind == EXTRA:
        _streams(r)
        kind = r.number()
    if kind == MAIN:
        s = _streams(r)
        kind = r.number()
    if kind == END:
        return
    if kind != FILES:
        raise MalformedData("files")
    n = r.count()
    names, times, attributes, empty, hollow, anti = [""] * n, {}, [None] * n, [False] * n, [], []
    while (kind := r.number()) != END:
        p = Reader(r.take(r.count()))
        if kind == EMPTY:
            empty = p.bits(n)
        elif kind == EMPTY_FILE:
            hollow = p.bits(sum(empty))
        elif kind == ANTI:
            anti = p.bits(sum(empty))
        elif kind == NAME:
            if p.byte():
                raise Unsupported("external names")
            names = p.data[p.at :].decode("utf-16-le").split("\0")[:-1]
            if len(names) != n:
                raise MalformedData("names")
        elif kind in (CTIME, ATIME, MTIME, ATTRIBUTES):
            known = p.defined(n)
            if p.byte():
                raise Unsupported("external properties")
            values = [int.from_bytes(p.take(4 if kind == ATTRIBUTES else 8), "little") if d else None for d in known]
            if kind == ATTRIBUTES:
                attributes = values
            else:
                times[kind] = values
    if sum(not e for e in empty) != len(s.sizes):
        raise MalformedData("streams and files differ in number")
    # where each substream is: folder, offset in it
    places, k, pack = [], 0, 0
    offsets = [sum(s.packs[:i]) for i in range(len(s.packs) + 1)]
    starts = []
    for i, (folder, c) in enumerate(zip(s.folders, s.counts)):
        starts.append(pack)
        at = 0
        for j in range(c):
            places.append((i, j, at))
            at += s.sizes[k]
            k += 1
        pack += len(folder.packed)
    held: dict[int, bytes] = {}

    def decoded(b: Body) -> bytes:
        if b.number not in held:
            held.clear()  # one solid block at a time
            held[b.number] = _folder(f, 0, b.folder, b.offsets, b.packs, password, limits)
        return held[b.number]

    def body_of(stream: int, path: str) -> Body:
        i, _, at = places[stream]
        m = slice(starts[i], starts[i] + len(s.folders[i].packed))
        return Body(path, i, s.folders[i], [32 + s.at + o for o in offsets[m]], s.packs[m], at, s.sizes[stream], s.crcs[stream], decoded)

    stream = blank = 0
    for i in range(n):
        mode = attributes[i] >> 16 if attributes[i] is not None and attributes[i] & 0x8000 else None
        when = {k: windows_time(v[i]) if v[i] is not None else None for k, v in times.items()}
        fields = {"windows_attributes": attributes[i], "unix_mode": mode}
        if empty[i]:
            is_file, dropped = bool(hollow and hollow[blank]), bool(anti and anti[blank])
            blank += 1
            if dropped:
                continue
            shape, size, body = (FILE if is_file else DIRECTORY), 0, b""
        else:
            folder, j, at = places[stream]
            g = s.folders[folder]
            shape, size, body = FILE, s.sizes[stream], body_of(stream, names[i])
            m = starts[folder]
            fields |= {"coder_graph": [c[0] for c in g.coders], "solid": s.counts[folder] > 1, "substream_index": j, "substream_count": s.counts[folder], "data_offset": 32 + s.at + offsets[m], "decoded_offset": at, "packed_size": sum(s.packs[m : m + len(g.packed)]), "crc32": s.crcs[stream]}
            stream += 1
        e = Entry(safe_path(names[i]), shape, size, mode & 0o7777 if mode is not None else None, when.get(MTIME), when.get(ATIME), when.get(CTIME), None, fields, body)
        if mode is not None and shape == FILE and type_of_mode(mode) == SYMLINK:
            e.type = SYMLINK
            e.link_target = e.read().decode()
        tracker.entry(e)
        yield e


# --- writer ---------------------------------------------------------------------------------------


def _put(n: int) -> bytes:
    for i in range(8):
        if n < 1 << 7 * (i + 1):
            first = (0xFF00 >> i) & 0xFF | n >> 8 * i
            return bytes([first]) + (n & (1 << 8 * i) - 1).to_bytes(i, "little")
    return b"\xff" + n.to_bytes(8, "little")


def _bitmap(bits: list[bool]) -> bytes:
    out = bytearray(-(-len(bits) // 8))
    for i, b in enumerate(bits):
        if b:
            out[i // 8] |= 0x80 >> i % 8
    return bytes(out)


def _packed(method: str, data: bytes) -> tuple[bytes, bytes]:
    """(packed, properties)."""
    if method == "copy":
        return data, b""
    if method == "lzma":
        return codecs.encode("lzma-raw", data, dict_size=1 << 20), b"\x5d" + (1 << 20).to_bytes(4, "little")
    if method == "lzma2":
        return codecs.encode("lzma2", data, dict_size=1 << 20), bytes([18])
    if method == "ppmd":
        order, memory = 6, 1 << 24
        return codecs.encode("ppmd", data, order=order, memory=memory), bytes([order]) + memory.to_bytes(4, "little")
    return codecs.encode(method, data), b""


def _coded(data: bytes, method: str, filters: tuple, password: str | None) -> tuple[list[bytes], bytes, list[int]]:
    """(packed streams, folder record, output sizes). Coders stand in order of decoding, the last first."""
    coder = lambda name, props, shape=b"": (bytes([len(CODERS[name]) | (16 if shape else 0) | (32 if props else 0)]) + CODERS[name] + shape + (_put(len(props)) + props if props else b""))
    if "bcj2" in filters:
        if len(filters) > 1 or password:
            raise Unsupported("BCJ2 stands alone")
        parts = transforms.bcj2_split(data)
        main, props = _packed(method, parts[0])
        record = _put(2) + coder("bcj2", b"", _put(4) + _put(1)) + coder(method, props) + _put(0) + _put(1) + b"".join(_put(i) for i in (4, 1, 2, 3))
        return [main, *parts[1:]], record, [len(data), len(parts[0])]
    chain, sizes = [], []
    for f in filters:
        name, distance = f if isinstance(f, tuple) else (f, 1)
        chain.append(coder(name, bytes([distance - 1]) if name == "delta" else b""))
        sizes.append(len(data))
        data = transforms.apply(name, data, True, distance)
    sizes.append(len(data))
    data, props = _packed(method, data)
    chain.append(coder(method, props))
    if password is not None:
        salt, iv, power = os.urandom(8), os.urandom(16), 12
        sizes.append(len(data))
        data = crypto.cbc_encrypt(crypto.sevenzip_key(password, salt, power), iv, data)
        chain.append(coder("aes", bytes([0xC0 | power, (len(salt) - 1) << 4 | len(iv) - 1]) + salt + iv))
    record = _put(len(chain)) + b"".join(chain) + b"".join(_put(i) + _put(i + 1) for i in range(len(chain) - 1))
    return [data], record, sizes


def _pack_info(at: int, packs: list[int]) -> bytes:
    return bytes([PACK]) + _put(at) + _put(len(packs)) + bytes([SIZE]) + b"".join(_put(n) for n in packs) + bytes([END])


def _folders(records: list[bytes], sizes: list[list[int]], crcs: list[int] | None) -> bytes:
    out = bytes([UNPACK, FOLDER]) + _put(len(records)) + b"\0" + b"".join(records) + bytes([UNPACK_SIZE]) + b"".join(_put(n) for x in sizes for n in x)
    if crcs:
        out += bytes([CRC, 1]) + b"".join(c.to_bytes(4, "little") for c in crcs)
    return out + bytes([END])


@dataclass
class Block:
    """Entries, without their bodies, and one folder with them: sizes and checksums by entry, 0 for empty ones."""

    entries: list[Entry]
    sizes: list[int]
    crcs: list[int]
    packs: list[bytes]
    record: bytes
    outputs: list[int]


def coded(entries: Iterable[Entry], method: str = "lzma2", filters: tuple = (), solid: int = 64, password: str | None = None, **_) -> Iterator[Block]:
    """Blocks of at most `solid` files that aren't empty."""
    held, bodies, full = [], [], 0

    def block() -> Block:
        packs, record, outputs = _coded(b"".join(bodies), method, tuple(filters), password) if full else ([], b"", [])
        return Block(held, [len(b) for b in bodies], [zlib.crc32(b) for b in bodies], packs, record, outputs)

    for e in entries:
        body = (e.link_target or "").encode() if e.type == SYMLINK else e.read() if e.type == FILE else b""
        if body and full == max(1, solid):
            yield block()
            held, bodies, full = [], [], 0
        held.append(replace(e, body=None))
        bodies.append(body)
        full += bool(body)
    if held:
        yield block()


def write(entries, out, method: str = "lzma2", filters: tuple = (), solid: int = 64, password: str | None = None, encrypt_headers: bool = False, **_) -> None:
    """solid: files in one block. Filters are names or ("delta", distance), first applied first; bcj2 stands alone."""
    joined(coded(entries, method, filters, solid, password), out, password, encrypt_headers)


def joined(blocks: Iterable[Block], out, password: str | None = None, encrypt_headers: bool = False, **_) -> None:
    """An archive of blocks, whoever coded them."""
    items, folders, body, packs = [], [], io.BytesIO(), []
    for b in blocks:
        items += zip(b.entries, b.sizes)
        if b.record:
            folders.append((b.record, b.outputs, [(n, c) for n, c in zip(b.sizes, b.crcs) if n]))
        packs += [len(p) for p in b.packs]
        for p in b.packs:
            body.write(p)
    header = bytes([HEADER])
    if folders:
        full = [x for _, _, x in folders]
        header += bytes([MAIN]) + _pack_info(0, packs) + _folders([r for r, _, _ in folders], [o for _, o, _ in folders], None)
        header += bytes([SUB, COUNT]) + b"".join(_put(len(x)) for x in full)
        if any(len(x) > 1 for x in full):
            header += bytes([SIZE]) + b"".join(_put(n) for x in full for n, _ in x[:-1])
        header += bytes([CRC, 1]) + b"".join(c.to_bytes(4, "little") for x in full for _, c in x) + bytes([END, END])
    prop = lambda kind, data: bytes([kind]) + _put(len(data)) + data
    header += bytes([FILES]) + _put(len(items))
    empty = [not n for _, n in items]
    if any(empty):
        header += prop(EMPTY, _bitmap(empty))
        hollow = [e.type != DIRECTORY for e, n in items if not n]
        if any(hollow):
            header += prop(EMPTY_FILE, _bitmap(hollow))
    header += prop(NAME, b"\0" + b"".join((e.path + "\0").encode("utf-16-le") for e, _ in items))
    for kind, get in ((CTIME, lambda e: e.ctime), (ATIME, lambda e: e.atime), (MTIME, lambda e: e.mtime)):
        known = [get(e) is not None for e, _ in items]
        if any(known):
            ticks = b"".join(((get(e) + 11_644_473_600 * 10**9) // 100).to_bytes(8, "little") for e, _ in items if get(e) is not None)
            header += prop(kind, (b"\1" if all(known) else b"\0" + _bitmap(known)) + b"\0" + ticks)
    modes = [(e.mode if e.mode is not None else 0o755 if e.type == DIRECTORY else 0o644) | mode_of_type(e.type) for e, _ in items]
    header += prop(ATTRIBUTES, b"\1\0" + b"".join((m << 16 | 0x8000 | (16 if e.type == DIRECTORY else 32)).to_bytes(4, "little") for m, (e, _) in zip(modes, items)))
    header += bytes([END, END])
    if encrypt_headers and password is not None:
        parts, record, outputs = _coded(header, "lzma", (), password)
        plain_crc = zlib.crc32(header)
        header = bytes([ENCODED]) + _pack_info(body.tell(), [len(p) for p in parts]) + _folders([record], [outputs], [plain_crc]) + bytes([END])
        for p in parts:
            body.write(p)
    start = struct.pack("<QQI", body.tell(), len(header), zlib.crc32(header))
    out.write(MAGIC + b"\0\4" + zlib.crc32(start).to_bytes(4, "little") + start + body.getvalue() + header)
