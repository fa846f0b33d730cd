"""Ciphers of archives: AES by tables built from its definition, ZIP's traditional stream cipher."""

from __future__ import annotations

import functools
import hashlib
import hmac
import zlib

import numpy as np

from ..errors import LimitExceeded, MalformedData, Unsupported


def _tables() -> tuple[bytes, list[list[int]], bytes, list[list[int]]]:
    """The S-box from inverses in GF(2^8), its inverse, and the column tables of both directions."""
    exp, log, x = [0] * 512, [0] * 256, 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    mul = lambda a, b: exp[log[a] + log[b]] if a and b else 0
    box = bytearray(256)
    for i in range(256):
        b = exp[255 - log[i]] if i else 0
        box[i] = b ^ 0x63
        for k in range(1, 5):
            box[i] ^= (b << k | b >> (8 - k)) & 0xFF
    back = bytearray(256)
    for i, b in enumerate(box):
        back[b] = i
    word = lambda *b: int.from_bytes(bytes(b), "big")
    enc = [word(mul(s, 2), s, s, mul(s, 3)) for s in box]
    dec = [word(mul(s, 14), mul(s, 9), mul(s, 13), mul(s, 11)) for s in back]
    turn = lambda t, k: [(w >> 8 * k | w << (32 - 8 * k)) & 0xFFFFFFFF for w in t] if k else t
    return bytes(box), [turn(enc, k) for k in range(4)], bytes(back), [turn(dec, k) for k in range(4)]


_BOX, _ENC, _BACK, _DEC = _tables()


class AES:
    """Block cipher with keys of 16, 24 or 32 bytes."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        self.rounds = n + 6
        words = [int.from_bytes(key[i : i + 4], "big") for i in range(0, len(key), 4)]
        sub = lambda w: int.from_bytes(bytes(_BOX[b] for b in w.to_bytes(4, "big")), "big")
        rcon = 1
        for i in range(n, 4 * (self.rounds + 1)):
            w = words[-1]
            if i % n == 0:
                w = sub((w << 8 | w >> 24) & 0xFFFFFFFF) ^ rcon << 24
                rcon = rcon << 1 ^ (0x11B if rcon & 0x80 else 0)
            elif n > 6 and i % n == 4:
                w = sub(w)
            words.append(words[i - n] ^ w)
        self.key = words
        d = list(words)
        for i in range(4, len(words) - 4):
            b = words[i].to_bytes(4, "big")
            d[i] = _DEC[0][_BOX[b[0]]] ^ _DEC[1][_BOX[b[1]]] ^ _DEC[2][_BOX[b[2]]] ^ _DEC[3][_BOX[b[3]]]
        self.back = d

    def _run(self, block: bytes, keys: list[int], order, tables, box: bytes, step: int) -> bytes:
        s = [int.from_bytes(block[i : i + 4], "big") ^ keys[order[0] + i // 4] for i in range(0, 16, 4)]
        t0, t1, t2, t3 = tables
        for k in order[1:-1]:
            s = [t0[s[i] >> 24] ^ t1[s[(i + step) % 4] >> 16 & 255] ^ t2[s[(i + 2 * step) % 4] >> 8 & 255] ^ t3[s[(i + 3 * step) % 4] & 255] ^ keys[k + i] for i in range(4)]
        k = order[-1]
        return b"".join((int.from_bytes(bytes((box[s[i] >> 24], box[s[(i + step) % 4] >> 16 & 255], box[s[(i + 2 * step) % 4] >> 8 & 255], box[s[(i + 3 * step) % 4] & 255])), "big") ^ keys[k + i]).to_bytes(4, "big") for i in range(4))

    def encrypt(self, block: bytes) -> bytes:
        return self._run(block, self.key, range(0, 4 * self.rounds + 4, 4), _ENC, _BOX, 1)

    def decrypt(self, block: bytes) -> bytes:
        return self._run(block, self.back, range(4 * self.rounds, -4, -4), _DEC, _BACK, -1)


    def many(self, data: bytes, back: bool) -> bytes:
        """Each block by itself, a megabyte at once: a column of four words per block."""
        if len(data) > 1 << 20:
            return b"".join(self.many(data[i : i + (1 << 20)], back) for i in range(0, len(data), 1 << 20))
        keys, step = (self.back, -1) if back else (self.key, 1)
        order = list(range(4 * self.rounds, -4, -4) if back else range(0, 4 * self.rounds + 4, 4))
        tables = [np.array(t, dtype=np.uint32) for t in (_DEC if back else _ENC)]
        box = np.frombuffer(bytes(_BACK if back else _BOX), np.uint8).astype(np.uint32)
        k = np.array(keys, dtype=np.uint32)[:, None]
        s = np.frombuffer(data, ">u4").reshape(-1, 4).T.astype(np.uint32) ^ k[order[0] : order[0] + 4]
        turned = lambda n: np.roll(s, -n * step, axis=0)
        byte = lambda x, n: x >> np.uint32(n) & np.uint32(255)
        for o in order[1:-1]:
            s = tables[0][s >> np.uint32(24)] ^ tables[1][byte(turned(1), 16)] ^ tables[2][byte(turned(2), 8)] ^ tables[3][byte(turned(3), 0)] ^ k[o : o + 4]
        o = order[-1]
        last = box[s >> np.uint32(24)] << np.uint32(24) | box[byte(turned(1), 16)] << np.uint32(16) | box[byte(turned(2), 8)] << np.uint32(8) | box[byte(turned(3), 0)]
        return (last ^ k[o : o + 4]).T.astype(">u4").tobytes()


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    if len(data) % 16:
        raise MalformedData("cipher text isn't whole blocks")
    return xor(AES(key).many(data, True), (iv + data)[: len(data)])


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    data += b"\0" * (-len(data) % 16)
    aes, out = AES(key), []
    for i in range(0, len(data), 16):
        iv = aes.encrypt(xor(data[i : i + 16], iv))
        out.append(iv)
    return b"".join(out)


def xor(a: bytes, b: bytes) -> bytes:
    n = min(len(a), len(b))
    return (int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).to_bytes(n, "big")


def _ctr(key: bytes, data: bytes) -> bytes:
    """Counter from 1, little-endian, as WinZip has it."""
    return xor(data, AES(key).many(b"".join(i.to_bytes(16, "little") for i in range(1, len(data) // 16 + 2)), False))


def _winzip_keys(password: bytes, salt: bytes, bits: int) -> tuple[bytes, bytes, bytes]:
    n = bits // 8
    raw = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * n + 2)
    return raw[:n], raw[n : 2 * n], raw[2 * n :]


def winzip_decrypt(data: bytes, password: bytes, bits: int) -> bytes:
    n = bits // 16
    salt, check, body, mac = data[:n], data[n : n + 2], data[n + 2 : -10], data[-10:]
    key, auth, expected = _winzip_keys(password, salt, bits)
    if check != expected:
        raise Unsupported("wrong password")
    if not hmac.compare_digest(hmac.new(auth, body, "sha1").digest()[:10], mac):
        raise MalformedData("authentication code")
    return _ctr(key, body)


def winzip_encrypt(data: bytes, password: bytes, bits: int, salt: bytes) -> bytes:
    key, auth, check = _winzip_keys(password, salt, bits)
    body = _ctr(key, data)
    return salt + check + body + hmac.new(auth, body, "sha1").digest()[:10]


class Traditional:
    """The three-key stream cipher of ZIP."""

    def __init__(self, password: bytes):
        self.k = [0x12345678, 0x23456789, 0x34567890]
        for b in password:
            self._feed(b)

    def _feed(self, b: int) -> None:
        k = self.k
        k[0] = zlib.crc32(bytes([b]), k[0] ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        k[1] = ((k[1] + (k[0] & 255)) * 134775813 + 1) & 0xFFFFFFFF
        k[2] = zlib.crc32(bytes([k[1] >> 24]), k[2] ^ 0xFFFFFFFF) ^ 0xFFFFFFFF

    def _mask(self) -> int:
        t = self.k[2] | 2
        return (t * (t ^ 1) >> 8) & 255

    def decrypt(self, data: bytes) -> bytes:
        out = bytearray()
        for c in data:
            b = c ^ self._mask()
            self._feed(b)
            out.append(b)
        return bytes(out)

    def encrypt(self, data: bytes) -> bytes:
        out = bytearray()
        for b in data:
            out.append(b ^ self._mask())
            self._feed(b)
        return bytes(out)


def sevenzip_key(password: str, salt: bytes, power: int) -> bytes:
    """SHA-256 over 2^power rounds of salt, password in UTF-16LE and a counter."""
    secret = password.encode("utf-16-le")
    if power == 0x3F:
        return (salt + secret)[:32].ljust(32, b"\0")
    h, part = hashlib.sha256(), salt + secret
    for i in range(0, 1 << power, 4096):
        h.update(b"".join(part + j.to_bytes(8, "little") for j in range(i, min(i + 4096, 1 << power))))
    return h.digest()


@functools.lru_cache(64)
def rar_three(password: str, salt: bytes) -> tuple[bytes, bytes]:
    """(key, initial vector) of RAR 3: SHA-1 over the password, the salt and a count, 2^18 times."""
    seed = password.encode("utf-16-le") + salt
    rounds, state, iv = 1 << 18, hashlib.sha1(), bytearray()
    for i in range(rounds):
        state.update(seed + i.to_bytes(3, "little"))
        if i % (rounds >> 4) == 0:
            iv.append(state.copy().digest()[-1])
    digest = state.digest()
    return b"".join(digest[i : i + 4][::-1] for i in range(0, 16, 4)), bytes(iv)


@functools.lru_cache(64)
def rar_five(password: str, salt: bytes, power: int) -> tuple[bytes, bytes, bytes]:
    """(key, key of checksums, check of the password) of RAR 5."""
    if power > 24:
        raise LimitExceeded("key rounds", 24, power)
    key, sums, check = (hashlib.pbkdf2_hmac("sha256", password.encode(), salt, (1 << power) + more, 32) for more in (0, 16, 32))
    return key, sums, functools.reduce(xor, (check[i : i + 8] for i in range(0, 32, 8)))


def rar_sum(key: bytes, value: bytes) -> bytes:
    """A checksum as RAR 5 stores it beside encrypted bodies: CRC-32 folded to four bytes, others whole."""
    found = hmac.new(key, value, "sha256").digest()
    return functools.reduce(xor, (found[i : i + 4] for i in range(0, 32, 4))) if len(value) == 4 else found
