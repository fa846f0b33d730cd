"""Formats and codecs without Spark: known answers, the standard library as the other side, damaged input."""

from __future__ import annotations

import base64
import io
import lzma
import random
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina import codecs
from lamina.codecs import jvm, lz4, native, ppmd
from lamina.errors import LimitExceeded, MalformedData, Unsupported
from lamina.formats import CATALOG, Entry, Limits, ar, cpio, rar, rar_lz, sevenz, tar, zip_
from lamina.functions import crypto, hashes, transforms
from lamina.functions.detect import detect_archive, detect_codec
from lamina.plans import rar_samples

R = random.Random(7)
CODE = bytes(R.choice([0xE8, 0xE9, 0, 255, 0x48, 0xEB, 0xF0, 0xF8, 0x0F, 0x84, 1, 7, R.randrange(256)]) for _ in range(20_000))
PLAIN = [b"", b"a", b"123456789", bytes(range(256)) * 8, R.randbytes(20_000), b"abc" * 9000, "héllo wörld ".encode() * 300, bytes(100_000)]


def sized(codec, n):
    """PPMd streams don't tell where they end."""
    return {"decoded_size": n} if codec.name == "ppmd" else {}


@pytest.mark.parametrize("codec", codecs.CATALOG, ids=lambda c: c.name)
def test_codecs_round_trip_and_stop_at_the_limit(codec):
    for data in PLAIN:
        packed = codec.encode(data)
        assert codec.decode(packed, max_output=1 << 20, **sized(codec, len(data))) == (data, len(packed))
        if len(data) > 1:
            with pytest.raises(LimitExceeded):
                codec.decode(packed, max_output=len(data) - 1, **sized(codec, len(data)))


@pytest.mark.parametrize("order, memory", [(2, 1 << 11), (6, 1 << 15), (16, 1 << 16), (64, 1 << 18)])
def test_ppmd_starts_anew_when_memory_runs_out(order, memory):
    for data in (CODE, PLAIN[4], bytes(range(256)) * 40, b"to be or not to be, " * 400):
        packed = codecs.encode("ppmd", data, order=order, memory=memory)
        assert codecs.decode("ppmd", packed, decoded_size=len(data), order=order, memory=memory) == data
    with pytest.raises(LimitExceeded):
        codecs.decode("ppmd", packed, decoded_size=10, order=order, memory=memory, max_memory=memory - 1)


@pytest.mark.parametrize("order, memory", [(2, 1 << 11), (6, 5002), (16, 1 << 16), (6, 1 << 24)])
def test_ppmd_is_the_same_in_the_jvm_and_without(monkeypatch, order, memory):
    def both(f, *args):
        monkeypatch.setattr(jvm, "_coded", jvm.START)
        monkeypatch.setattr(jvm, "_usable", True)
        found = outcome(f, *args)
        assert jvm._coder is not None and jvm._usable
        monkeypatch.setattr(jvm, "_usable", False)
        assert outcome(f, *args) == found
        return found

    def outcome(f, *args):
        try:
            return f(*args)
        except MalformedData as e:
            return str(e)

    for data in (*PLAIN[:6], CODE[:9000]):
        packed = both(ppmd.encode, data, order, memory)
        assert both(ppmd.decode, packed, 1 << 20, len(data), order, memory) == (data, len(packed))
        damaged = bytearray(packed)
        damaged[len(packed) // 2 or 1] ^= 0x55
        both(ppmd.decode, bytes(damaged), 1 << 20, len(data), order, memory)
        both(ppmd.decode, packed[: max(5, len(packed) // 2)], 1 << 20, len(data) + 100, order, memory)


def test_ppmd_goes_on_without_a_jvm(monkeypatch):
    """A JVM that ends during its work leaves the rest to Python."""
    monkeypatch.setattr(jvm, "_coded", jvm.START)
    packed = ppmd.encode(CODE)
    monkeypatch.setattr(jvm, "_usable", True)
    jvm._coder.process.kill()
    with pytest.warns(UserWarning, match="without a JVM"):
        assert ppmd.encode(CODE) == packed
    assert jvm._coder is None and ppmd.decode(packed, 1 << 20, len(CODE))[0] == CODE


def test_ppmd_keeps_up():
    """Python alone takes a minute for this."""
    import time

    data = CODE * 30 + " ".join(map(str, range(60_000))).encode()
    began = time.perf_counter()
    assert codecs.decode("ppmd", codecs.encode("ppmd", data), decoded_size=len(data)) == data
    assert time.perf_counter() - began < 20


def test_7z_of_ppmd_keeps_up():
    """Half a megabyte in many entries; Python alone takes half a minute to write and as long to read it."""
    import time

    bodies = [CODE[i : i + 4000] + str(i).encode() for i in range(0, 16_000, 125)]
    began = time.perf_counter()
    out = io.BytesIO()
    sevenz.write([Entry(f"{i}.bin", body=b) for i, b in enumerate(bodies)], out, method="ppmd")
    assert [e.read() for e in sevenz.read(out)] == bodies
    assert time.perf_counter() - began < 15


def test_many_small_frames_take_time_by_the_frame():
    """Frames are found without copying what follows."""
    import time

    def seconds(n):
        data = codecs.encode("gzip", b"x") * n
        began = time.perf_counter()
        assert codecs.decode("gzip", data) == b"x" * n
        return time.perf_counter() - began

    assert seconds(40_000) < 40 * max(seconds(4_000), 0.01)


@pytest.mark.parametrize("codec", [c for c in codecs.CATALOG if c.framed], ids=lambda c: c.name)
def test_frames_follow_each_other(codec):
    two = codec.encode(b"first") + codec.encode(b"second")
    assert codecs.decode(codec.name, two) == b"firstsecond"
    first, n = codecs.decode_frame(codec.name, two)
    assert first == b"first" and codecs.decode(codec.name, two[n:]) == b"second"


@pytest.mark.parametrize("codec", codecs.CATALOG, ids=lambda c: c.name)
def test_damaged_streams_raise_declared_errors(codec):
    r = random.Random(11)
    packed = codec.encode(b"a line of text\n" + bytes(range(16)) * 60)
    for _ in range(60):
        broken = bytearray(packed[: r.randrange(len(packed) + 1)] if r.random() < 0.3 else packed)
        for _ in range(r.randrange(1, 4)):
            if broken:
                broken[r.randrange(len(broken))] = r.randrange(256)
        try:
            out, _ = codec.decode(bytes(broken), max_output=1 << 20, **sized(codec, 975))
            assert len(out) <= 1 << 20
        except (MalformedData, LimitExceeded, Unsupported):
            pass


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=600), st.sampled_from(["lz4", "lz4-block", "compress", "deflate64"]))
def test_own_codecs_on_any_bytes(data, name):
    assert codecs.decode(name, codecs.encode(name, data)) == data


def test_deflate64_reads_what_deflate_writes():
    """Without the longest length both formats agree."""
    data = b"some words that repeat, some words that do not " * 4
    assert codecs.decode("deflate64", codecs.encode("deflate", data)) == data


def test_zstd_seek_table_and_frames():
    data = R.randbytes(5_500)
    packed = codecs.encode("zstd", data, frame_size=1000)
    assert len(native.zstd_seek_table(packed)) == 6 and native.zstd_read_range(packed, 990, 1020) == data[990:2010]
    assert [f[2] for f in native.zstd_frames(packed)] == [False] * 6 + [True]
    assert codecs.decode("zstd", packed) == data and native.zstd_seek_table(codecs.encode("zstd", data)) is None


def test_lz4_dictionary_and_options():
    history = b"shared history of both sides"
    packed = lz4.frame_encode(b"history of both sides", dictionary=history, dictionary_id=5, block_checksum=True, content_size=True)
    assert codecs.decode("lz4", packed, dictionary=history) == b"history of both sides"
    with pytest.raises(Unsupported):
        codecs.decode("lz4", packed)
    linked = lz4.frame_encode(b"abcd" * 40_000, block_size=4, independent=False)
    assert codecs.decode("lz4", linked) == b"abcd" * 40_000


def test_known_checksums():
    check = b"123456789"
    assert (zlib.adler32(check), hashes.crc32c(check), hashes.crc64_xz(check), hashes.crc32_bzip2(check)) == (0x091E01DE, 0xE3069283, 0x995DC9BBDF1939FA, 0xFC891918)
    assert (hashes.xxh32(b""), hashes.xxh32(b"abc"), hashes.xxh64(b""), hashes.xxh64(b"abc")) == (0x02CC5D05, 0x32D153FF, 0xEF46DB3751D8E999, 0x44BC2CF5AD770999)
    assert hashes.blake2sp(b"").hex().startswith("dd0e8917") and hashes.blake2sp(b"").hex().endswith("f2ca4f")
    for name in ("CRC32", "CRC32C", "ADLER32", "SHA-256", "XXH32", "XXH64", "CRC64-XZ"):
        whole, parts = hashes.Accumulator(name).update(CODE), hashes.Accumulator(name).update(CODE[:777]).update(CODE[777:])
        assert whole.finish() == parts.finish() == parts.finish()
        with pytest.raises(ValueError):
            parts.update(b"x")


def test_aes_vectors():
    text = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, expected in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        aes = crypto.AES(bytes(range(n)))
        assert aes.encrypt(text).hex() == expected and aes.decrypt(aes.encrypt(text)) == text


FILTERS = {"x86": lzma.FILTER_X86, "ppc": lzma.FILTER_POWERPC, "ia64": lzma.FILTER_IA64, "arm": lzma.FILTER_ARM, "thumb": lzma.FILTER_ARMTHUMB, "sparc": lzma.FILTER_SPARC}


@pytest.mark.parametrize("name", [*transforms.BRANCHES, "delta"])
def test_transforms(name):
    there = transforms.apply(name, CODE, True, 4)
    assert len(there) == len(CODE) and transforms.apply(name, there, False, 4) == CODE
    if name in FILTERS:
        # the library's filter, followed by LZMA2, taken off by that decoder alone
        packed = lzma.compress(CODE, lzma.FORMAT_RAW, filters=[{"id": FILTERS[name]}, {"id": lzma.FILTER_LZMA2}])
        assert lzma.decompress(packed, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2}]) == there


def test_bcj2():
    for data in (CODE, b"", b"\xe8" * 50, CODE[:7]):
        assert transforms.bcj2_merge(*transforms.bcj2_split(data), len(data)) == data


ENTRIES = [
    Entry("dir", "directory", mode=0o755, mtime=1_700_000_000 * 10**9),
    Entry("dir/a.txt", mtime=1_700_000_001 * 10**9, mode=0o640, body=b"hello" * 100),
    Entry("dir/empty", body=b""),
    Entry("x" * 120 + "/" + "y" * 120, body=CODE),
    Entry("ünï", body=b"u" * 3001),
]
LINK = [Entry("ln", "symlink", link_target="dir/a.txt")]


def there_and_back(fmt, entries, write=None, read=None):
    out = io.BytesIO()
    CATALOG[fmt][4](entries, out, **(write or {}))
    assert detect_archive(out.getvalue()[:1024]) == fmt or (write or {}).get("preamble")
    got = list(CATALOG[fmt][3](io.BytesIO(out.getvalue()), **(read or {})))
    view = lambda es: [(e.path.rstrip("/"), e.type, e.read() if e.type == "file" else e.link_target) for e in es]
    assert view(got) == view(entries)
    return out.getvalue(), got


@pytest.mark.parametrize("how", [{"dialect": d} for d in ("newc", "crc", "odc", "binary")] + [{"dialect": "binary", "byte_order": "big"}])
def test_cpio(how):
    data, got = there_and_back("cpio", ENTRIES + LINK, how)
    assert got[1].mode == 0o640 and got[1].mtime == 1_700_000_001 * 10**9 and len(data) % 512 == 0
    with pytest.raises(MalformedData):
        list(cpio.read(io.BytesIO(data[: len(data) // 2])))
    if how["dialect"] == "crc":
        at = data.index(b"hello")
        with pytest.raises(MalformedData):
            list(cpio.read(io.BytesIO(data[:at] + b"J" + data[at + 1 :])))


def test_ar_and_its_name_tables():
    there_and_back("ar", [e for e in ENTRIES if e.type == "file"])
    member = lambda name, body: name.ljust(16) + b"0           0     0     644     " + b"%d" % len(body) + b" " * (10 - len(b"%d" % len(body))) + b"`\n" + body + b"\n" * (len(body) % 2)
    data = ar.MAGIC + member(b"/", b"\0\0\0\0") + member(b"//", b"a_rather_long_name.o/\n") + member(b"/0", b"one") + member(b"short.o/", b"two")
    assert [(e.path, e.read()) for e in ar.read(io.BytesIO(data))] == [("a_rather_long_name.o", b"one"), ("short.o", b"two")]


def test_tar_against_the_library():
    data, _ = there_and_back("tar", [*ENTRIES, *LINK, Entry("hl", "hardlink", link_target="dir/a.txt")])
    other = tarfile.open(fileobj=io.BytesIO(data))
    assert [m.name for m in other] == [e.path for e in ENTRIES] + ["ln", "hl"] and other.extractfile("dir/a.txt").read() == b"hello" * 100
    for fmt in (tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT):
        out = io.BytesIO()
        names = ["a/b", "q" * 90 + "/" + "z" * 60] + (["w" * 300, "é" * 120] if fmt != tarfile.USTAR_FORMAT else [])
        with tarfile.open(fileobj=out, mode="w", format=fmt) as t:
            for n in names:
                info = tarfile.TarInfo(n)
                info.size, info.mtime = 5, 1_700_000_000.5 if fmt == tarfile.PAX_FORMAT else 17
                t.addfile(info, io.BytesIO(b"12345"))
        got = list(tar.read(io.BytesIO(out.getvalue())))
        assert [e.path for e in got] == names and {e.read() for e in got} == {b"12345"}
        assert got[0].mtime == (1_700_000_000_500_000_000 if fmt == tarfile.PAX_FORMAT else 17 * 10**9)


def test_tar_sparse_files():
    def pax(records, body, name=b"f"):
        data = b"".join(tar._record(k, v) for k, v in records)
        return tar._header(b"p", b"", 0o644, 0, 0, len(data), 0, b"x", b"", b"", b"") + data + bytes(-len(data) % 512) + tar._header(name, b"", 0o644, 0, 0, len(body), 0, b"0", b"", b"", b"") + body + bytes(-len(body) % 512)

    expected = bytes(10) + b"AAAA" + bytes(6) + b"BB" + bytes(8)
    old = [("GNU.sparse.size", b"30"), ("GNU.sparse.numblocks", b"2"), ("GNU.sparse.offset", b"10"), ("GNU.sparse.numbytes", b"4"), ("GNU.sparse.offset", b"20"), ("GNU.sparse.numbytes", b"2")]
    mapped = [("GNU.sparse.size", b"30"), ("GNU.sparse.name", b"real"), ("GNU.sparse.map", b"10,4,20,2")]
    newest = [("GNU.sparse.major", b"1"), ("GNU.sparse.minor", b"0"), ("GNU.sparse.name", b"real"), ("GNU.sparse.realsize", b"30")]
    head = b"2\n10\n4\n20\n2\n".ljust(512, b"\0")
    for records, body, name in ((old, b"AAAABB", "f"), (mapped, b"AAAABB", "real"), (newest, head + b"AAAABB", "real")):
        e = next(iter(tar.read(io.BytesIO(pax(records, body) + bytes(1024)))))
        assert (e.path, e.size, e.read()) == (name, 30, expected)


@pytest.mark.parametrize("method", list(zip_.METHODS.values()))
def test_zip_methods(method):
    if method == "zstd-deprecated":
        return
    data, got = there_and_back("zip", ENTRIES + LINK, {"method": method})
    there_and_back("zip", ENTRIES, {"method": method, "descriptor": True}, {"mode": "stream"})
    assert got[1].mode == 0o640 and got[1].mtime == 1_700_000_001 * 10**9
    if method in ("stored", "deflated", "bzip2", "lzma"):
        other = zipfile.ZipFile(io.BytesIO(data))
        assert other.testzip() is None and other.read("dir/a.txt") == b"hello" * 100


def test_zip_from_the_library_preamble_and_duplicates():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/ü", b"x" * 999)
        z.writestr("b", b"")
    assert [(e.path, len(e.read())) for e in zip_.read(io.BytesIO(b"stub" * 9 + out.getvalue()))] == [("a/ü", 999), ("b", 0)]
    there_and_back("zip", ENTRIES, {"preamble": b"#!stub" * 10})
    twice = io.BytesIO()
    zip_.write([Entry("a", body=b"1"), Entry("./a", body=b"2")], twice)
    with pytest.raises(MalformedData):
        list(zip_.read(io.BytesIO(twice.getvalue())))
    assert len(list(zip_.read(io.BytesIO(twice.getvalue()), mode="stream"))) == 2


@pytest.mark.parametrize("scheme", ["traditional", "aes-128", "aes-192", "aes-256"])
def test_zip_encryption(scheme):
    data, _ = there_and_back("zip", ENTRIES, {"encrypt": scheme, "password": "pw"}, {"password": "pw"})
    e = [x for x in zip_.read(io.BytesIO(data), password="no") if x.path == "dir/a.txt"][0]
    with pytest.raises((Unsupported, MalformedData)):
        e.read()
    if scheme == "traditional":
        assert zipfile.ZipFile(io.BytesIO(data)).read("dir/a.txt", pwd=b"pw") == b"hello" * 100


@pytest.mark.parametrize("how", [{"method": m} for m in ("copy", "lzma", "lzma2", "bzip2", "deflate", "deflate64", "zstd")] + [{"filters": f, "solid": 2} for f in (("x86",), ("arm64",), (("delta", 4),), ("bcj2",), ("x86", ("delta", 2)))])
def test_sevenz(how):
    _, got = there_and_back("7z", ENTRIES + LINK, how)
    assert got[1].mode == 0o640 and got[1].mtime == 1_700_000_001 * 10**9
    there_and_back("7z", [], how)


def test_sevenz_encryption():
    there_and_back("7z", ENTRIES, {"password": "pä"}, {"password": "pä"})
    data, _ = there_and_back("7z", ENTRIES, {"password": "p", "encrypt_headers": True}, {"password": "p"})
    assert b"d\0i\0r" not in data
    with pytest.raises(Unsupported):
        list(sevenz.read(io.BytesIO(data)))


def rar4(name=b"a.txt", body=b"body", flags=0, method=0x30, size=None, crc=None):
    block = lambda kind, fl, rest: (lambda h: struct.pack("<H", zlib.crc32(h) & 0xFFFF) + h)(struct.pack("<BHH", kind, fl, 7 + len(rest)) + rest)
    head = struct.pack("<IIBIIBBHI", len(body), len(body) if size is None else size, 3, zlib.crc32(body) if crc is None else crc, 0x5A21 << 16, 29, method, len(name), 0o100644) + name
    return rar.OLD + block(0x73, 0, bytes(6)) + block(0x74, 0x8000 | flags, head) + body + block(0x7B, 0, b"")


def rar5(name=b"b.txt", body=b"five", blake=False, crc=None):
    def block(fields, extra=b"", data=b""):
        kind, flags, rest = fields
        flags |= (1 if extra else 0) | (2 if data else 0)
        raw = bytes([kind, flags]) + (bytes([len(extra)]) if extra else b"") + (bytes([len(data)]) if data else b"") + rest + extra
        raw = bytes([len(raw)]) + raw
        return struct.pack("<I", zlib.crc32(raw)) + raw + data

    hashed = bytes([34, 2, 0]) + hashes.blake2sp(body) if blake else b""
    head = bytes([4, len(body), 0xA4, 0x03]) + struct.pack("<I", zlib.crc32(body) if crc is None else crc) + bytes([0, 1, len(name)]) + name
    return rar.NEW + block((1, 0, b"\0")) + block((2, 0, head), hashed, body) + block((5, 0, b"\0"))


def test_rar_stored():
    e = next(iter(rar.read(io.BytesIO(b"stub" + rar4()))))
    assert (e.path, e.type, e.size, e.mode, e.read(), e.fields["host_os"]) == ("a.txt", "file", 4, 0o644, b"body", "unix")
    e = next(iter(rar.read(io.BytesIO(rar5(blake=True)))))
    assert (e.path, e.size, e.mode, e.read()) == ("b.txt", 4, 0o644, b"five")
    with pytest.raises(MalformedData):
        next(iter(rar.read(io.BytesIO(rar5(crc=1))))).read()
    with pytest.raises(MalformedData):
        next(iter(rar.read(io.BytesIO(rar4(method=0x33))))).read()


#: Archives of the format's own tool with the password junrar: solid ones of file1.txt to file9.txt,
#: each holding its name without ending and a line feed, and single encrypted files, with plain and encrypted headers.
RAR_SAMPLES = {
    "five solid": "UmFyIRoHAQAJ78hvCwEFBwQGAQGAgIAA5PLueR8CApsABoYApIMCY0kUXwT3KeKAGwEJZmlsZTEudHh0wYMYNDAz+EAy3Ybv0QWJRKH8DMPdhxsia/YACAfgmR8CAoUABoYApIMCY0kUX8ekBMnAGwEJZmlsZTIudHh0QhoCe4DgrmJzHwIChQAGhgCkgwJjSRRfhpUf0MAbAQlmaWxlMy50eHRCGgJ8ALv5fIsfAgKFAAaGAKSDAmNJFF9BA16fwBsBCWZpbGU0LnR4dEIaAnyAU1D+YR8CAoUABoYApIMCY0kUXwAyRYbAGwEJZmlsZTUudHh0QhoCfQAqrAiFHwIChQAGhgCkgwJjSRRfw2ForcAbAQlmaWxlNi50eHRCGgJ9gMIFim8fAgKFAAaGAKSDAmNJFF+CUHO0wBsBCWZpbGU3LnR4dEIaAn4A3QRFrh8CAoUABoYApIMCY0kUX01M6zPAGwEJZmlsZTgudHh0QhoCfoA1rcdEHwIChQAGhgCkgwJjSRRfDH3wKsAbAQlmaWxlOS50eHRCGgJ/AB13VlEDBQQA",
    "five headers": "UmFyIRoHAQAYOJrPIQQAAAEPprqRs1Vs70VeAnJr65GiUWzJnBs88EB6pEDZCDMNebpM1FRWRidOoP8NEKunwvQXSE6qyWZSmFdTmJz5B4PRrGmc/9wgf07nAr0VnT/SUD7KGRm04mC2+uJap3bok3fPNwjtWnVbqxga+30ke8uVJYZkiuuGhz7dmPmsjcbbifv8JRtif4lMcFsoiFclxaKGgHWEAQ5iUr3A418NqLr87fq2lB4LpFyCVjVgrfNS3Ou5IdI1MBz0SPemsbqYy9mjOR0uTISWgDqgl9qBApSZxzov0pm4HbMDGpR2jEAzLnvZFtWMyUYPoVpguDM=",
    "five body": "UmFyIRoHAQAzkrXlCgEFBgAFAQGAgABfIc6zUQIDMaAABoYApIMCY0kUXxnn0+uAAwEJZmlsZTEudHh0MAEAAw+rgP7jvy7bm3QlOdS3YZwFYG45NDcQ1tsYPE/SbYZEVJmc4Qhprj8yi5S4gj56t2Cqe0X/M28NnKG0ccGCC/yKLzwOLmAr44eAnrJUHXdWUQMFBAA=",
    "four solid": "UmFyIRoHADvQcwgADQAAAAAAAACylHSAkCsAGgAAAAYAAAADBPcp4veq81AdMwkApIEAAGZpbGUxLnR4dADADQwM/hAMt2G79EFqVSh/2gEYP7Diz78doSBa4XSQkCsAAwAAAAYAAAADx6QEyfeq81AdMwkApIEAAGZpbGUyLnR4dADAepIAyjN0kJArAAMAAAAGAAAAA4aVH9D3qvNQHTMJAKSBAABmaWxlMy50eHQAwHsSAPkEdJCQKwADAAAABgAAAANBA16f96rzUB0zCQCkgQAAZmlsZTQudHh0AMB7kgBp1nSQkCsAAwAAAAYAAAADADJFhveq81AdMwkApIEAAGZpbGU1LnR4dADAfBIAmKd0kJArAAMAAAAGAAAAA8NhaK33qvNQHTMJAKSBAABmaWxlNi50eHQAwHySAAh1dJCQKwADAAAABgAAAAOCUHO096rzUB0zCQCkgQAAZmlsZTcudHh0AMB9EgD+yXSQkCsAAwAAAAYAAAADTUzrM/eq81AdMwkApIEAAGZpbGU4LnR4dADAfZIAbht0kJArAAMAAAAGAAAAAwx98Cr3qvNQHTMJAKSBAABmaWxlOS50eHQAwH4SgMQ9ewBABwA=",
    "four headers": "UmFyIRoHAM6Zc4AADQAAAAAAAAC5PWsXQCo7KTFMRRa743HEkQGnfYjGSpKHt825oSyxCV2WDs3/AhC15uLyC1vdqD3ZMfc1QT5xF6bbvZU5vlm7C1ewuX2zpB/y0IluICILdJAyPey4XXsY0qQOAhCYeXgNFqlwuBxUOrk9axdAKjspjUYtP7PIL6k2eg0gENTs9Q==",
    "four body": "UmFyIRoHAM+QcwAADQAAAAAAAADqWnQklDMAIAAAAAYAAAADBPcp4veq81AdMwkApIEAAGZpbGUxLnR4dFioM3YCpGjgAMAsmDgcSsnwnUn6kzM4BlpBbF+uQO0D7ORxNIz3Z4nsScQ9ewBABwA=",
}


@pytest.mark.parametrize("name", RAR_SAMPLES)
def test_rar_of_its_own_tool(name):
    data = base64.b64decode(RAR_SAMPLES[name])
    entries = list(rar.read(io.BytesIO(data), password="junrar"))
    assert [e.path for e in entries] == [f"file{i + 1}.txt" for i in range(len(entries))] and len(entries) == (9 if "solid" in name else 1)
    for i in [*range(len(entries)), len(entries) // 3, 0, -1]:  # in any order
        e = entries[i]
        assert e.read() == e.path.replace(".txt", "\n").encode()
    if "solid" not in name:
        for other in (None, "wrong"):
            with pytest.raises((MalformedData, Unsupported)):
                [e.read() for e in rar.read(io.BytesIO(data), password=other)]


class Writer5:
    """A body of literals, matches and filters in flat codes, written symbol by symbol."""

    def __init__(self):
        self.bits, self.out, self.filters = [], bytearray(), []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def size(self, size, width, first):
        slot = size - 2 if size < 10 else next(s for s in range(8, 44) if ((4 | s & 3) << (s >> 2) - 1) <= size - 2 < ((4 | s & 3) + 1 << (s >> 2) - 1))
        self.put(first + slot, width)
        if slot >= 8:
            self.put(size - 2 & (1 << (slot >> 2) - 1) - 1, (slot >> 2) - 1)

    def literal(self, byte):
        self.put(byte, 9)
        self.out.append(byte)

    def copied(self, size, back):
        for _ in range(size):
            self.out.append(self.out[-back])

    def match(self, size, back):
        self.copied(size, back)
        self.size(size - (back > 0x100) - (back > 0x2000) - (back > 0x40000), 9, 262)
        slot = back - 1 if back < 5 else next(s for s in range(4, 64) if ((2 | s & 1) << (s >> 1) - 1) <= back - 1 < ((2 | s & 1) + 1 << (s >> 1) - 1))
        self.put(slot, 6)
        if slot >= 4:
            n, rest = (slot >> 1) - 1, back - 1
            if n >= 4:
                self.put(rest >> 4 & (1 << n - 4) - 1, n - 4)
                self.put(rest & 15, 4)
            else:
                self.put(rest & (1 << n) - 1, n)

    def filter(self, size, kind, channels=1):
        """Over the next bytes."""
        self.put(256, 9)
        for v in (0, size):
            self.put(1, 2)
            self.put(v & 255, 8)
            self.put(v >> 8, 8)
        self.put(kind, 3)
        if kind == 0:
            self.put(channels - 1, 5)

    def body(self):
        head = [b for many, n in ((20, 4),) for _ in range(many) for b in (0, 1, 0, 1)]
        head += [n >> i & 1 for many, n in ((306, 9), (64, 6), (16, 4), (44, 6)) for _ in range(many) for i in range(4, -1, -1)]
        bits = head + self.bits
        data = np.packbits(bits).tobytes()
        flags, size = 0xC0 | 2 << 3 | (len(bits) - 1) % 8, len(data).to_bytes(3, "little")
        return bytes([flags, 0x5A ^ flags ^ size[0] ^ size[1] ^ size[2]]) + size + data


@pytest.mark.parametrize("seed", range(4))
def test_rar_five_matches(seed):
    r, w = random.Random(seed), Writer5()
    for b in r.randbytes(40):
        w.literal(b)
    recent = [0, 0, 0, 0]
    for _ in range(1500):
        kind = r.random()
        if kind < 0.4:
            w.literal(r.randrange(256))
        elif kind < 0.8 or not all(recent):
            back = r.randint(1, min(len(w.out), 1 << r.randint(1, 19)))
            w.match(size := r.randint(6, 1 << r.randint(3, 9)), back)
            recent = [back, *recent[:3]]
        elif kind < 0.9:
            k = r.randrange(4)
            recent.insert(0, recent.pop(k))
            w.put(258 + k, 9)
            w.size(size := r.randint(2, 300), 6, 0)
            w.copied(size, recent[0])
        else:
            w.put(257, 9)
            w.copied(size, recent[0])
    assert rar_lz.Five(1 << 20).decode(w.body(), len(w.out), False) == bytes(w.out)


def test_rar_filters():
    plain = bytes(CODE[:4000])
    # calls to absolute places below 16 MiB, as the format's encoder leaves them
    code, at = bytearray(plain), 0
    while at + 4 < len(code):
        at += 1
        if code[at - 1] == 0xE8:
            target = int.from_bytes(code[at : at + 4], "little", signed=True)
            if -at <= target < (1 << 24) - at:
                code[at : at + 4] = (target + at if target + at >= 0 else target).to_bytes(4, "little", signed=True)
            elif (1 << 24) - at <= target < 1 << 24:
                code[at : at + 4] = (target - (1 << 24)).to_bytes(4, "little", signed=True)
            at += 4
    w = Writer5()
    w.filter(len(code), 1)
    for b in code:
        w.literal(b)
    assert rar_lz.Five(1 << 17).decode(w.body(), len(code), False) == plain
    woven = b"".join(bytes((plain[i - 3] if i >= 3 else 0) - plain[i] & 255 for i in range(c, len(plain), 3)) for c in range(3))
    w = Writer5()
    w.filter(len(plain), 0, 3)
    for b in woven:
        w.literal(b)
    assert rar_lz.Five(1 << 17).decode(w.body(), len(plain), False) == plain


class CarrylessEncoder:
    """What PPMd blocks of RAR are written with."""

    def __init__(self):
        self.low, self.range, self.out = 0, 0xFFFFFFFF, bytearray()

    def narrow(self, below, size, total):
        self.range //= total
        self.low, self.range = self.low + below * self.range & 0xFFFFFFFF, self.range * size
        while True:
            if (self.low ^ self.low + self.range) & 0xFFFFFFFF >= 1 << 24:
                if self.range >= 1 << 15:
                    return
                self.range = -self.low & 0x7FFF
            self.shift()

    def shift(self):
        self.out.append(self.low >> 24)
        self.low, self.range = self.low << 8 & 0xFFFFFFFF, self.range << 8 & 0xFFFFFFFF

    def bit(self, size, wanted):
        self.narrow(size if wanted else 0, (1 << 14) - size if wanted else size, 1 << 14)
        return wanted


def test_rar_four_models():
    plain = b"to be, or not to be, that is the question: \x02 " * 60 + CODE[:500]
    model, coder = ppmd.Model(5, 1 << 20), CarrylessEncoder()
    for b in plain:
        model.step(coder, b)
        if b == 2:
            model.step(coder, 1)  # the escape stands for itself
    for b in (2, 5, 20, 2, 4, 0, 0, 9, 3):  # repeats of one byte, and from eleven bytes back
        model.step(coder, b)
    for _ in range(4):
        coder.shift()
    want = bytearray(plain) + plain[-1:] * 24
    for _ in range(35):
        want.append(want[-11])
    data = bytes([0x80 | 0x20 | 4, 0]) + bytes(coder.out)
    assert rar_lz.Four(1 << 22).decode(data, len(want), False) == bytes(want)


def test_rar_volumes():
    """Parts of a body in volumes, joined."""
    body = bytes(CODE[:3000])
    for make in (rar_samples.five, rar_samples.four):
        whole = make([("a.bin", body), ("b.bin", body[:10])], True)
        assert [e.read() for e in rar.read(io.BytesIO(whole))] == [body, body[:10]]
    head = lambda data, flags, crc: rar4(b"a.bin", data, flags, size=len(body), crc=crc)
    two = head(body[:1000], 2, 1) + head(body[1000:], 1, zlib.crc32(body))
    assert [(e.path, e.read()) for e in rar.read(io.BytesIO(two))] == [("a.bin", body)]
    with pytest.raises(Unsupported):
        next(iter(rar.read(io.BytesIO(head(body[:1000], 2, 1))))).read()


@pytest.mark.parametrize("fmt", ["ar", "cpio", "tar", "zip", "7z", "rar"])
def test_damaged_archives_raise_declared_errors(fmt):
    body = b"a line of text\n" + bytes(range(16)) * 8
    if fmt == "rar":
        data = rar4(body=body)
    else:
        out = io.BytesIO()
        CATALOG[fmt][4]([Entry("payload.bin", body=body)], out)
        data = out.getvalue()
    r = random.Random(5)
    limits = Limits(16, 1 << 20, 1 << 20, 1 << 20)
    cases = [data[:i] for i in range(0, len(data), max(1, len(data) // 40))]
    for _ in range(128):
        broken = bytearray(data)
        for _ in range(r.randrange(1, 5)):
            broken[r.randrange(len(broken))] = r.randrange(256)
        cases.append(bytes(broken))
    for case in cases:
        try:
            for e in CATALOG[fmt][3](io.BytesIO(case), limits=limits):
                assert len(e.read()) <= 1 << 20
        except (MalformedData, LimitExceeded, Unsupported, UnicodeDecodeError):
            pass


@pytest.mark.parametrize("limits,kind", [(Limits(max_entry_count=1), "entry_count"), (Limits(max_entry_size=100), "entry_size"), (Limits(max_total_entry_size=600), "total_entry_size"), (Limits(max_metadata_size=40), "metadata_size")])
@pytest.mark.parametrize("fmt", ["ar", "cpio", "tar", "zip", "7z"])
def test_limits(fmt, limits, kind):
    out = io.BytesIO()
    CATALOG[fmt][4]([Entry("a", body=bytes(500)), Entry("b", body=bytes(500))], out)
    with pytest.raises(LimitExceeded) as e:
        list(CATALOG[fmt][3](io.BytesIO(out.getvalue()), limits=limits))
    assert e.value.kind == kind and e.value.actual > e.value.maximum


@pytest.mark.parametrize("path", ["/a", "C:x", "../a", "a/..", ".", "", "a\\..\\b"])
def test_unsafe_paths(path):
    from lamina.formats.entry import safe_path

    with pytest.raises(MalformedData):
        safe_path(path)


def test_detection_of_codecs():
    for c in codecs.CATALOG:
        assert detect_codec(codecs.encode(c.name, b"text " * 50)[:1024]) == (c.name if c.probe else detect_codec(codecs.encode(c.name, b"text " * 50)[:1024]))
    assert detect_codec(b"\x50\x2a\x4d\x18\0\0\0\0") == "lz4"
