"""Plain versions of the contracts, over lists of rows."""

from __future__ import annotations

import hashlib
import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def repeats_words(docs, size=50):
    """docs: (doc_id, text). Rows (doc_id, n_words, n_removed, kept_sha256)."""
    words = [WORD.findall(t or "") for _, t in docs]
    last = (1 << 63) - 1
    ids = [last if d is None else d for d, _ in docs]
    least = {}
    for i, w in zip(ids, words):
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            least[k] = min(least.get(k, last), i)
    out = []
    for (d, _), i, w in zip(docs, ids, words):
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if least[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), sha(kept.encode())))
    return out


def repeats_bytes(docs, size=400):
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    raws = [(t or "").encode() for _, t in docs]
    seen = {}
    for r in raws:
        for p in range(len(r) - size + 1):
            k = r[p : p + size]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (d, _), r in zip(docs, raws):
        gone = bytearray(len(r))
        for p in range(len(r) - size + 1):
            if seen[r[p : p + size]] > 1:
                gone[p : p + size] = b"\x01" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(r, gone) if not g)
        out.append((d, len(r), sum(gone), spans, sha(kept)))
    return out


def later_bytes(docs, keys, floor=256):
    """keys: a number per row that orders rows of one doc_id. Rows (doc_id, n_later, n_earlier_docs, first_kept_sha256)."""
    last = (1 << 63) - 1
    raws = [(t or "").encode() for _, t in docs]
    ids = [last if d is None else d for d, _ in docs]
    first, least = {}, {}
    for i, k, r in zip(ids, keys, raws):
        for p in range(len(r) - floor + 1):
            s = r[p : p + floor]
            first[s] = min(first.get(s, (i, k, p)), (i, k, p))
            least[s] = min(least.get(s, i), i)
    out = []
    for (d, _), i, k, r in zip(docs, ids, keys, raws):
        gone, other = bytearray(len(r)), bytearray(len(r))
        for p in range(len(r) - floor + 1):
            s = r[p : p + floor]
            if first[s] < (i, k, p):
                gone[p : p + floor] = b"\x01" * floor
            if least[s] < i:
                other[p : p + floor] = b"\x01" * floor
        out.append((d, sum(gone), sum(other), sha(bytes(x for x, g in zip(r, gone) if not g))))
    return out


def simhash(text):
    import xxhash

    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near(docs):
    """Rows (doc_id, fingerprint, component_id)."""
    fps = [simhash(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(docs)]


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def contaminated(docs, items):
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    words = lambda t: ITEM.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    lengths = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[k]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((d, len(w), len(hit), len(found - {None}), sha(names.encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def quote_lines(text):
    """(level, body) of a message's lines; -1 for lines that announce a quote."""
    out = []
    for line in re.split("\r?\n", text or ""):
        m = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
        out.append((m.group(1).count(">"), line[m.end() :]) if m else (0, line))
    return [(-1, b) if lv == 0 and i + 1 < len(out) and out[i + 1][0] > 0 and re.search(r"(?i)^[ \t]*on\b.*\bwrote:[ \t]*$", b) else (lv, b) for i, (lv, b) in enumerate(out)]


def quote_normal(text):
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip(" ") or re.sub(r"\s+", " ", text).strip(" ")


def quote_units(text, quoted):
    """(level, passage, part, text) of whole passages and of their lines."""
    out = set()
    for lv, group in itertools.groupby(quote_lines(text), key=lambda x: x[0]):
        if (lv > 0) if quoted else (lv == 0):
            bodies = [b for _, b in group]
            whole = quote_normal("\n".join(bodies))
            out |= {u for u in [(lv, whole, 0, whole), *((lv, whole, 1, quote_normal(b)) for b in bodies)] if u[3]}
    return out


def conversations(rows, min_chars=8):
    """rows: (conv, turn, role, text). Rows (conv, turn, n_quotes, max_level, quotes, parent, thread, depth, position, clean)."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    said, links = {}, {}
    for c, t, _, x in rows:
        if t is not None:
            for u in quote_units(x, False):
                said.setdefault((c, u[3]), set()).add(t)
    for c, t, _, x in rows:
        if t is None:
            continue
        found = [(u, max(s)) for u in quote_units(x, True) if (s := [y for y in said.get((c, u[3]), ()) if y < t])]
        for (lv, passage, part, text), source in found:
            if part == min(u[2] for u, _ in found if u[:2] == (lv, passage)):
                links.setdefault((c, t), set()).add((lv, md5(text), len(text) < min_chars, source))
    parent = {k: max((-lv, not weak, source) for lv, _, weak, source in v)[2] for k, v in links.items()}
    out = []
    for c, t, role, x in rows:
        at, depth = t, 0
        while (c, at) in parent:
            at, depth = parent[c, at], depth + 1
        read = quote_lines(x)
        clean = re.sub(r"\n{3,}", "\n\n", "\n".join(b for lv, b in read if lv == 0)).strip(" ")
        groups = [lv for lv, _ in itertools.groupby(read, key=lambda y: y[0])]
        out.append((c, t, sum(lv > 0 for lv in groups), max(0, max(groups)), tuple(sorted((lv, p, s) for lv, p, _, s in links.get((c, t), ()))), parent.get((c, t)), at, depth, role, clean))
    none = lambda v: (v is not None, v if v is not None else 0)
    out.sort(key=lambda r: (none(r[0]), none(r[6]), r[7], none(r[1]), (r[8] is not None, (r[8] or "").encode()), r[9].encode()))
    first = {}
    for i, r in enumerate(out):
        first.setdefault(r[0], i)
    return [(*r[:8], i - first[r[0]], r[9]) for i, r in enumerate(out)]


FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate")


def features(text):
    n, chars, symbols, dup, repeat, _ = statistics(text)
    per = lambda a, b: a * 1000 // b if b else 0
    return n, per(chars, n), per(symbols, chars), per(dup, n), per(repeat, n)


def learned_rules(rows, max_rules=6, max_conditions=3, min_covered=8, min_precision=0.9):
    """Sequential covering over plain rows (doc_id, features, quality): rules that throw documents out, as lists of (feature, op, threshold)."""
    import math

    import xxhash

    part = lambda d: (xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42) + 2**63) % 2**64 - 2**63
    left = [(part(d) % 3 == 0, f, q) for d, f, q in rows]
    met = lambda f, conditions: all(f[i] <= v if op == "<=" else f[i] > v for i, op, v in conditions)
    count = lambda rs: (sum(q == 0 for _, _, q in rs), sum(q == 1 for _, _, q in rs))

    def starts(grow):
        p0, n0 = count(grow)
        found = []
        for i in range(len(FEATURES)):
            for rank, op in enumerate(("<=", ">")):
                best = None
                for v in sorted({f[i] for _, f, _ in grow}):
                    some = [r for r in grow if met(r[1], [(i, op, v)])]
                    a, b = count(some)
                    if a and len(some) < len(grow):
                        gain = round(a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0))), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, v)
                if best:
                    found.append((-best[0], i, best[1], rank, (i, op, best[1])))
        return [x[-1] for x in sorted(found)]

    rules = []
    for _ in range(max_rules):
        grow, held = [r for r in left if not r[0]], [r for r in left if r[0]]
        if not all(count(grow)):
            break
        for first in starts(grow):
            conditions = [first]
            while len(conditions) < max_conditions and count(some := [r for r in grow if met(r[1], conditions)])[1]:
                more = starts(some)
                if not more:
                    break
                conditions.append(more[0])
            worth = []
            for k in range(1, len(conditions) + 1):
                p, n = count([r for r in held if met(r[1], conditions[:k])])
                worth.append(((p - n) / max(1, p + n), -k, p, n))
            _, k, p, n = max(worth)
            if p + n >= max(1, min_covered // 3) and p >= min_precision * (p + n):
                rules.append(conditions[: -k])
                break
        else:
            break
        left = [r for r in left if not met(r[1], rules[-1])]
    return rules


def kept_documents(docs, labels):
    """Rows (doc_id, kept): the base rule, then the rules learned from labelled documents that pass it."""
    known = {}
    for d, q in labels:
        if d is not None and q in (0, 1):
            known.setdefault(d, []).append(q)
    rules = learned_rules([(d, features(t), q) for d, t in docs if not statistics(t)[-1] for q in known.get(d, ())])
    out = []
    for d, t in docs:
        f = features(t)
        caught = any(all(f[i] <= v if op == "<=" else f[i] > v for i, op, v in r) for r in rules)
        out.append((d, not statistics(t)[-1] and not caught))
    return out, rules
