"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is 8 positional bytes. Two fingerprints that differ in at most 3 bits share at least
8 - 3 = 5 bytes in place. Lists of single bytes would hold a 256th of all fingerprints each, so the
index lists combinations of positions instead: each half of the 8 positions has 4 triples, and five
shared positions always fill three of one half, so these 8 triples miss no pair. Per list, the shared
positional bytes of each pair are tallied, pairs below 5 are dropped, the rest is verified by bits.
Distinct fingerprints are indexed, copies are one entry. A list gives a tree over each set it links,
not all its pairs; trees of all lists are joined to components by alternating star steps, each behind
a checkpoint. Lists longer than `crowd` are split by two more positions, again without a miss; in those
that stay long each fingerprint looks up its neighbours, which takes no pairs.

Null and empty texts have fingerprint 0 and are linked like any other. A null doc_id never names a
component unless it has no other member; then the name is null. Extra columns are carried along.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, as_bytes, aside, beside, row_key, stored, with_keys

SHINGLE, BITS, SHARED = 3, 3, 5
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
#: Fingerprints of one list that are compared pair by pair; of more, each looks its neighbours up.
PAIRWISE = 4_096


def fingerprint(raw: bytes) -> int:
    """SimHash over XXH64 of word triples; bytes.lower() and bytes.split() act on ASCII only."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxh64_intdigest(text, 42)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: len(words) - SHINGLE]]
        hashes = [xxh64_intdigest(text[a : b - 1], 42) for a, b in zip(starts, ends[SHINGLE - 1 :])]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """Bits that more than half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, rk, fp per row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t) for t in as_bytes(batch.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc", "rk", "fp"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, rk long, fp long")


def byte_at(p: int):
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))


def listed(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """Postings (part, key, fp): one per set of positions."""
    entries = [F.struct(F.lit(i).alias("part"), sum(F.shiftleft(byte_at(p), 8 * k) for k, p in enumerate(s)).alias("key")) for i, s in enumerate(sets)]
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.part", "e.key", "fp")


def close_pairs(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of one group that are within BITS, through SHARED bytes in place; groups stand in a row."""
    n = len(fp)
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    last = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    left, right, d = [], [], 1
    at = np.arange(n)
    while len(at := at[at + d < last[at]]):
        x = fp[at] ^ fp[at + d]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        some = np.flatnonzero(shared >= SHARED)
        some = some[np.bitwise_count(x[some]) <= BITS]
        left.append(at[some])
        right.append(at[some] + d)
        d += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def looked_up(fp: np.ndarray, positions: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The same of one large list whose fingerprints share five bytes: they differ in up to BITS bits of the
    three others, so each of the 2,324 differences is tried on all of them at once. Work grows with the list."""
    free = [p for p in range(8) if p not in positions]
    value = sum((fp >> np.uint64(8 * p) & np.uint64(255)) << np.uint64(8 * i) for i, p in enumerate(free)).astype(np.int64)
    place = np.full(1 << 24, -1, dtype=np.int32)
    place[value] = np.arange(len(fp))
    left, right = [], []
    for bits in (c for k in range(1, BITS + 1) for c in combinations(range(24), k)):
        other = place[value ^ sum(1 << b for b in bits)]
        some = np.flatnonzero(other > np.arange(len(fp)))
        left.append(some)
        right.append(other[some])
    return np.concatenate(left), np.concatenate(right)


def trees(fp: np.ndarray, group: np.ndarray, sets: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Of lists, given in a row and named by key * 64 + number of the set of positions, edges that link what is close."""
    n = len(fp)
    label = np.arange(n)
    edge = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), n)
    large = np.flatnonzero(np.diff(edge) > PAIRWISE)
    large = [g for g in large.tolist() if len(sets[int(group[edge[g]]) & 63]) == SHARED]
    small = np.ones(n, dtype=bool)
    pairs = []
    for g in large:
        small[edge[g] : edge[g + 1]] = False
        a, b = looked_up(fp[edge[g] : edge[g + 1]], sets[int(group[edge[g]]) & 63])
        pairs.append((a + edge[g], b + edge[g]))
    at = np.flatnonzero(small)
    a, b = close_pairs(fp[at], group[at]) if len(at) else (at, at)
    pairs.append((at[a], at[b]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label) and np.array_equal(label[a], label[b]):
            break
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def linked(postings: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """Edges (u, v) of each list's trees; `part` numbers the sets of positions."""

    def run(batches):
        import pyarrow as pa

        def edges(held):
            part, key, fp = (np.concatenate(c) for c in zip(*held))
            a, b = trees(fp.view(np.uint64), key * 64 + part, sets)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["u", "v"])

        held, size = [], 0
        for batch in batches:
            part, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            part = part.astype(np.int64)
            if size > 200_000:
                # whole lists only: what goes on from the last batch waits
                cut = np.flatnonzero((part != held[-1][0][-1]) | (key != held[-1][1][-1]))
                cut = cut[0] if len(cut) else len(fp)
                held.append((part[:cut], key[:cut], fp[:cut]))
                if cut == len(fp):
                    size += cut
                    continue
                yield edges(held)
                held, size = [], 0
                part, key, fp = part[cut:], key[cut:], fp[cut:]
            held.append((part, key, fp))
            size += len(fp)
        if held:
            yield edges(held)

    return postings.repartition("part", "key").sortWithinPartitions("part", "key").select("part", "key", "fp").mapInArrow(run, "u long, v long")


def edges(fps: DataFrame, crowd: int = 20_000) -> DataFrame:
    """Links between distinct fingerprints, enough to connect what is connected."""
    fives = list(combinations(range(8), SHARED))
    postings = listed(fps, TRIPLES)
    long = stored(postings.groupBy("part", "key").count().where(f"count > {crowd}").select("part", "key"))
    if long.isEmpty():
        return linked(postings, TRIPLES).distinct()
    # pairs of a long list share its triple and two more positions
    finer = postings.join(long, ["part", "key"], "left_semi").groupBy("fp").agg(F.collect_set("part").alias("parts"))
    wanted = [F.struct(F.lit(i).alias("part"), sum(F.shiftleft(byte_at(p), 8 * k) for k, p in enumerate(s)).alias("key")) for i, s in enumerate(fives)]
    allowed = [F.arrays_overlap("parts", F.array(*[F.lit(j) for j, t in enumerate(TRIPLES) if set(t) <= set(s)] or [F.lit(-1)])) for s in fives]
    split = finer.select("fp", F.explode(F.filter(F.array(*[F.when(a, w) for a, w in zip(allowed, wanted)]), lambda e: e.isNotNull())).alias("e")).select("e.part", "e.key", "fp")
    return linked(postings.join(long, ["part", "key"], "left_anti"), TRIPLES).unionByName(linked(split, fives)).distinct()


def stars(links: DataFrame) -> DataFrame:
    """(v, m): every linked v with the smallest m of its component, by alternating large and small stars."""

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = None
    while (now := state(e)) != before and now[0]:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        e = stored(small.distinct())
    return e.select(F.col("u").alias("fp"), F.col("v").alias("m"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, rk, fp), and per fingerprint its component and the first row (doc, rk) of the component."""
    rows = stored(fingerprints(docs, id_col, text_col))
    classes = stored(rows.groupBy("fp").agg(F.min(F.struct("doc", "rk")).alias("first")))
    links = edges(classes.select("fp"), crowd)
    named = classes.join(stars(links), "fp", "left").select("fp", "first", F.coalesce("m", "fp").alias("component"))
    named = stored(named)
    return rows, named.join(named.groupBy("component").agg(F.min("first").alias("head")), "component").select("fp", "component", "head")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 20_000) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component)."""
    rows, named = components(docs, id_col, text_col, crowd)
    return rows.join(named, "fp").select(F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif(F.col("head.doc"), F.lit(NULL_ID)).alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 20_000) -> DataFrame:
    """One row of each component: that of the smallest doc_id."""
    rows, named = components(docs, id_col, text_col, crowd)
    heads = named.select("head.doc", "head.rk").distinct()
    kept = stored(rows.join(heads, ["doc", "rk"]).groupBy("doc", "rk").count())
    keys = lambda k: k.select(F.nullif("doc", F.lit(NULL_ID)).alias("id"), F.col("rk").alias("key"))
    once, again = kept.where("count = 1"), kept.where("count > 1")
    out = with_keys(docs, keys(once), "left_semi", id_col, text_col)
    if not again.isEmpty():
        # rows that came repeatedly, and only these, are compared as rows
        some = with_keys(docs, keys(again), "left_semi", id_col, text_col)
        some = aside(some, id=F.col(id_col), key=row_key(id_col, text_col)).dropDuplicates(["id", "key"])
        out = out.unionByName(beside(some))
    return out
