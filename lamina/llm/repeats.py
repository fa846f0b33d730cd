"""Long repeats of words between texts, found through anchored runs.

Every window of `size` words is given one anchor, a place inside it that its own content alone decides,
so equal windows have equal anchors at equal offsets. Neighbouring windows with the same anchor form a
run, which is described by the anchor's name, two 64-bit hashes of the run's content (one modulo 2^64,
one modulo two primes), and where it starts. Then, on these short rows only:

1. runs of equal content are counted as one, so thousands of copies are one row;
2. contents whose anchor name occurs once are dropped: no window of theirs can be repeated;
3. where a name has several contents, one run of each is cut out of its text, and windows of runs
   with the same name are compared in order of content;
4. every run learns which of its windows are repeated, and rows go back to their texts as spans.

A name that a third of all texts share is spread: contents are aggregated before they are exchanged,
joins on names are split by adaptive execution, and names with more than `crowd` contents have their
windows counted by an aggregation instead of in one worker. Rows are known by (doc_id, row key).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import I1, M1, NULL_ID, PrimeRolling, Rolling, Scratch, as_bytes, chunks, row_key

RUN = "key long, h1 long, h2 long, doc long, rk long, start int, n int"
CONTENT = "key long, h1 long, h2 long, lo long, crowd long, n int, content binary"
FLAG = "key long, h1 long, h2 long, span array<int>"


@dataclass(frozen=True)
class Kind:
    """How long windows are and how they get anchors.

    anchors(words, ends, size) gives for each window start the place of its anchor and the names by place.
    """

    size: int
    anchors: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]
    segment: int = 1 << 21  # units worked on at once; a window's anchor needs no more than the window


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))


def run_rows(kind: Kind, texts: list[bytes]) -> tuple[np.ndarray, ...] | None:
    """Runs of some texts: (text, name, h1, h2, start in its text, windows). Long texts go in segments."""
    digits, ends = word_units(texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    parts = []
    for a in range(0, max(0, len(digits) - kind.size + 1), kind.segment):
        b = min(len(digits), a + kind.segment + kind.size - 1)
        if (found := _segment_runs(kind, digits[a:b], np.clip(ends - a, 0, b - a))) is not None:
            t, name, h1, h2, begin, n = found
            parts.append((t, name, h1, h2, begin + a - starts[t], n))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else None


def _segment_runs(kind: Kind, digits: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...] | None:
    sizes = np.diff(ends, prepend=0)
    if not np.any(sizes >= kind.size):
        return None
    anchor, names = kind.anchors(digits, ends, kind.size)
    of = np.repeat(np.arange(len(ends)), sizes)
    windows = np.arange(len(anchor))
    windows = windows[of[windows] == of[windows + kind.size - 1]]
    a, t = anchor[windows], of[windows]
    first = np.ones(len(windows), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(windows)))
    begin = windows[at]
    end = begin + n + kind.size - 1
    h1, h2 = Rolling(digits, M1, I1).of(begin, end), PrimeRolling(digits).of(begin, end)
    return t[at], names[a[at]], h1, h2, begin, n


def runs(kind: Kind, docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            doc, rk = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = as_bytes(batch.column(2))
            for lo, hi in chunks(texts):
                if (found := run_rows(kind, texts[lo:hi])) is not None:
                    t, name, h1, h2, start, n = found
                    cols = [name.view(np.int64), h1.view(np.int64), h2.view(np.int64), doc[lo + t], rk[lo + t], start.astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [f.split()[0] for f in RUN.split(", ")])

    return docs.mapInArrow(run, RUN)


def contents(kind: Kind, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Cut the wanted runs out of their texts, as two hashes per window, which is less than their words."""
    per = wanted.groupBy("doc", "rk").agg(F.collect_list(F.struct("key", "h1", "h2", "lo", "crowd", "start", "n")).alias("w"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, asked = as_bytes(batch.column(0)), batch.column(1)
            offsets = asked.offsets.to_numpy()
            flat = asked.values.flatten()
            key, h1, h2, lo_id, many, start, n = (x.to_numpy(zero_copy_only=False) for x in flat)
            for lo, hi in chunks(texts):
                digits, ends = word_units(texts[lo:hi])
                begins = np.concatenate([[0], ends[:-1]])
                r = slice(offsets[lo], offsets[hi])
                at = np.repeat(begins, np.diff(offsets[lo : hi + 1])) + start[r]
                p, m = np.repeat(at, n[r]), n[r].astype(np.int64)
                p += np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)
                both = np.stack([rolling.of(p, p + kind.size) for rolling in (Rolling(digits, M1, I1), PrimeRolling(digits))], axis=1)
                edge = np.append(0, np.cumsum(m)).tolist()
                cut = [both[s:e].tobytes() for s, e in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[r]) for x in (key, h1, h2, lo_id, many, n)), pa.array(cut, pa.binary())], ["key", "h1", "h2", "lo", "crowd", "n", "content"])

    # a row that comes repeatedly is cut more than once: the later steps don't mind
    return docs.join(per, ["doc", "rk"]).select("text", "w").mapInArrow(run, CONTENT)


def window_hashes(content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(content number, offset, h1, h2) of all windows."""
    both = np.frombuffer(b"".join(content), dtype=np.uint64).reshape(-1, 2)
    n = np.array([len(c) for c in content], dtype=np.int64) // 16
    which = np.repeat(np.arange(len(content)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), both[:, 0], both[:, 1]


def spans_of(flag: np.ndarray, which: np.ndarray, x: np.ndarray, count: int) -> list[list[int]]:
    """Per content the flagged offsets as flat pairs (first, last)."""
    out: list[list[int]] = [[] for _ in range(count)]
    at = np.flatnonzero(flag)
    if len(at):
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(which[at]) != 0))
        for s, e in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]):
            out[which[s]] += [int(x[s]), int(x[e])]
    return out


def compared(kind: Kind, judge, cut: DataFrame, crowd: int) -> DataFrame:
    """Flagged windows of each content that repeats another content of the same name.

    judge(order, same, which, lo) gets windows in order of content, marks of equality with the one
    before, and flags those that are repeated.
    """

    def flags(rows):
        import pyarrow as pa

        key, h1, h2, lo, content = rows
        which, x, w1, w2 = window_hashes(content)
        order = np.lexsort((lo[which], w2, w1))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
        flag = np.zeros(len(order), dtype=bool)
        flag[order] = judge(order, same, which, lo)
        found = spans_of(flag, which, x, len(content))
        some = [i for i, f in enumerate(found) if f]
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(h1[some]), pa.array(h2[some]), pa.array([found[i] for i in some], pa.list_(pa.int32()))], ["key", "h1", "h2", "span"])

    def run(batches):
        """Whole names at a time, up to some megabytes of windows; the rows arrive sorted by name."""
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "h1", "h2", "lo", "content")]
            for row in zip(*cols):
                if row[0] != last and size > 4_000_000:
                    yield flags(columns(held))
                    held, size = [], 0
                if held and row[:3] == held[-1][:3]:
                    continue
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield flags(columns(held))

    def columns(held):
        return (*(np.array([r[i] for r in held], dtype=np.int64) for i in range(4)), [r[4] for r in held])

    few = cut.where(f"crowd <= {crowd}").drop("crowd").repartition("key").sortWithinPartitions("key", "h1", "h2").mapInArrow(run, FLAG)
    return few


def crowded(kind: Kind, cut: DataFrame, crowd: int) -> DataFrame:
    """The same for names with more contents than a worker should hold: windows are counted by aggregation."""

    def run(batches):
        import pyarrow as pa

        names = ["key", "h1", "h2", "lo", "x", "w1", "w2"]
        for batch in batches:
            content = batch.column("content").to_pylist()
            for s in range(0, len(content), 500):
                part = content[s : s + 500]
                if part:
                    which, x, w1, w2 = window_hashes(part)
                    own = [batch.column(c).to_numpy(zero_copy_only=False)[s : s + 500][which] for c in ("key", "h1", "h2", "lo")]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*own, x.astype(np.int32), w1.view(np.int64), w2.view(np.int64))], names)

    windows = cut.where(f"crowd > {crowd}").drop("crowd").dropDuplicates(["key", "h1", "h2"]).mapInArrow(run, "key long, h1 long, h2 long, lo long, x int, w1 long, w2 long")
    least = windows.groupBy("key", "w1", "w2").agg(F.min("lo").alias("least"))
    hit = windows.join(least, ["key", "w1", "w2"]).where("least < lo")
    return hit.groupBy("key", "h1", "h2").agg(F.flatten(F.transform(F.array_sort(F.collect_set("x")), lambda x: F.array(x, x))).alias("span"))


def earlier_judge(order, same, which, lo):
    """Windows that start in a smaller doc_id too: not the smallest of their class."""
    ids = lo[which[order]]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return ids > ids[head]


def repeated_spans(kind: Kind, docs: DataFrame, scratch: Scratch, judge, crowd: int = 20_000) -> DataFrame:
    """Per (doc, rk) of prepared documents the spans of repeated windows: flat pairs (first, last + size).

    Contents are counted before anything meets by name, so a hot name brings its distinct contents
    only; tables between the steps give each join exchanges of its own, which can be split.
    """
    found = scratch.table("runs", runs(kind, docs))
    every = scratch.table("every", found.groupBy("key", "h1", "h2").agg(F.min("doc").alias("lo"), F.count("*").alias("times"), F.min(F.struct("doc", "rk", "start", "n")).alias("rep")))
    names = scratch.table("names", every.groupBy("key").agg(F.sum("times").alias("of"), F.count("*").alias("crowd")).where("of > 1").drop("of"))
    classes = scratch.table("classes", every.join(names, "key"))
    scratch.drop("every", "names")
    wanted = classes.where("crowd > 1").select("key", "h1", "h2", "lo", "crowd", "rep.doc", "rep.rk", "rep.start", "rep.n")
    cut = scratch.table("contents", contents(kind, wanted, docs))
    flags = compared(kind, judge, cut, crowd)
    if not cut.where(f"crowd > {crowd}").isEmpty():
        flags = flags.unionByName(crowded(kind, cut, crowd))
    # a run without repeated windows has no row here
    known = scratch.table("known", classes.select("key", "h1", "h2", "lo", "times").join(scratch.table("flags", flags), ["key", "h1", "h2"], "left").where("span is not null or times > 1"))
    scratch.drop("contents", "classes", "flags")
    whole = F.array(F.col("start"), F.col("start") + F.col("n") - 1 + kind.size)
    parts = F.transform("span", lambda x, i: F.col("start") + x + F.when(i % 2 == 1, kind.size).otherwise(0))
    spans = found.join(known, ["key", "h1", "h2"]).select("doc", "rk", F.when(F.expr("doc > lo"), whole).otherwise(parts).alias("s")).where("s is not null")
    spans = scratch.table("spans", spans.groupBy("doc", "rk").agg(F.flatten(F.collect_set("s")).alias("spans")))
    scratch.drop("runs", "known")
    return spans


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each document row with its spans, or null."""
    return docs.join(spans, ["doc", "rk"], "left").select("doc", "text", "spans")


def covered(spans, n: int) -> np.ndarray:
    """Marks of the units that flat pairs (start, end) cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if spans is not None and len(spans):
        s = np.asarray(spans)
        np.add.at(edge, s[0::2], 1)
        np.add.at(edge, s[1::2], -1)
    return np.cumsum(edge[:-1]) > 0


# --- units --------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240501))
#: A random 64-bit digit per byte.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts]).astype(np.int64)


def word_bounds(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[np.frombuffer(buffer, dtype=np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_units(texts: list[bytes], block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word, and where each text's words end. Long texts go in blocks that end with a word."""
    hashes, ends, total = [], [], 0
    for lo, hi in chunks(texts, block):
        buffer = b"\n".join(texts[lo:hi])
        at, starts = 0, []
        while at < len(buffer):
            to = min(len(buffer), at + block)
            while to < len(buffer) and not _IS_SPACE[buffer[to]]:
                to += 1
            s, e = word_bounds(buffer[at:to])
            raw = np.frombuffer(buffer, dtype=np.uint8, count=to - at, offset=at)
            hashes.append(Rolling(BYTE[raw], M1, I1).of(s, e) ^ (e - s).astype(np.uint64))
            starts.append(s + at)
            at = to
        s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        ends.append(total + np.searchsorted(s, np.cumsum([len(t) + 1 for t in texts[lo:hi]])))
        total += len(s)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *hashes]), np.concatenate([np.zeros(0, np.int64), *ends]).astype(np.int64)
