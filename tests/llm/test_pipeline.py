"""Each pipeline stage against a plain version on its own input, and the registered queries on a small table."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from lamina.llm import license_scan, quality_rules, sharding

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, near copies, contaminated, short and noisy ones, and a hot source."""
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(20, 40))) for i in range(8)]
    docs, labels = [], []
    for i in range(240):
        kind = i % 8
        t = text(r.randint(40, 160))
        if kind == 1:
            t = " ".join(w + "###" for w in t.split())
        elif kind == 2 and i > 8:
            t = docs[i - 5][1] or "none"
        elif kind == 3 and i > 8:
            w = (docs[i - 8][1] or "none").split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif kind == 4:
            t = t + " " + items[i % 8][1]
        elif kind == 5:
            t = text(10)
        docs.append((i, t, "en", "big" if i % 3 else f"s{i % 4}", len(t)))
        if i % 2:
            labels.append((i, int(kind != 1), 0))
    docs += [(300, None, "en", "big", None), (301, "", None, None, 0), docs[7], docs[7]]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def stage(i):
    return corpus_pipeline.STAGES[i][1]


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def features(t):
    n, chars, symbols, dup, repeat, _ = brute.statistics(t)
    per = lambda a, b: a * 1000 // b if b else 0
    return {"n_words": n, "mean_word": per(chars, n), "symbol_rate": per(symbols, chars), "dup_line_rate": per(dup, n), "repeat_rate": per(repeat, n)}


def test_stages(spark, tables):
    d, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    _, rules = quality_rules.judged(quality_rules.with_statistics(docs).drop("text"), spark.read.parquet(f"{d}/labels.parquet"))

    def good(t):
        if brute.statistics(t)[5]:
            return False
        f = features(t)
        for rule in rules.rules:
            if all(f[c] <= v if op == "<=" else f[c] > v for c, op, v in rule.conditions):
                return rule.label == 1
        return rules.default == 1

    kept = stage(0)(spark, docs, d)
    expected = Counter({r: n for r, n in rows(docs).items() if good(r[1])})
    assert rows(kept) == expected and kept.columns == COLUMNS and rules.rules
    assert all("###" not in (r[1] or "") for r in expected)

    single = stage(1)(spark, kept, d)
    have = [(r[0], r[1]) for r, n in rows(kept).items() for _ in range(n)]
    assert Counter(r[0] for r in rows(single).elements()) == Counter({c for _, _, c in brute.near(have)})

    clean = stage(2)(spark, single, d)
    have = [(r[0], r[1]) for r in rows(single)]
    assert {r[0] for r in rows(clean)} == {x[0] for x in brute.contaminated(have, items) if not x[-1]}
    assert 0 < clean.count() < single.count()

    mix = stage(3)(spark, clean, d)
    assert rows(mix) == plain_mix(list(rows(clean).elements())) and mix.columns == COLUMNS

    placed = stage(4)(spark, mix, d).collect()
    assert {k: list(v) for k, v in plain_shards([tuple(r[c] for c in COLUMNS) for r in placed]).items()} == {s: [r.doc_id for r in sorted((x for x in placed if x.shard == s), key=lambda x: x.slot)] for s in sorted({x.shard for x in placed})}
    assert len(placed) == mix.count()


def plain_mix(docs):
    size = lambda r: len(brute.WORD.findall(r[1] or ""))
    names = sorted({r[3] for r in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size(r) for r in docs if r[3] == s) for s in names}
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    total, open_, target = sum(own.values()), list(names), {}
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * own[s]]
        target |= {s: float(3 * own[s]) for s in full} if full else {s: level * weight[s] for s in open_}
        open_ = [s for s in open_ if s not in full] if full else []
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    order = sorted(docs, key=lambda r: ((r[3] is None, r[3] or ""), md5(f"mix:{r[0]}:{md5(r[1] or '')}"), r[0]))
    sent, line = Counter(), []
    for k, r in enumerate(order):
        sent[r[3]] += size(r)
        line += [((sent[r[3]] + own[r[3]] * e) / target[r[3]], k, e) for e in range(3) if target[r[3]] > 0]
    out, used = Counter(), 0
    for _, k, _ in sorted(line):
        used += size(order[k])
        if used > total:
            break
        out[order[k]] += 1
    return out


def plain_shards(docs):
    import zlib

    order = sorted(docs, key=lambda r: (r[0], zlib.crc32(r[1].encode())))
    n = len(order)
    a, b = sharding.grid(n)
    f = lambda x, m, c: ((y := (x % sharding.PRIME * m + c) % sharding.PRIME) * y % sharding.PRIME * m + x % 65521 + c) % sharding.PRIME

    def once(p):
        left, right = divmod(p, b)
        for i, (m, c) in enumerate(sharding.round_keys(7, 6)):
            left, right = ((left + f(right, m, c)) % a, right) if i % 2 == 0 else (left, (right + f(left, m, c)) % b)
        return left * b + right

    places = {}
    for i, r in enumerate(order):
        p = once(i)
        while p >= n:
            p = once(p)
        places[p] = r[0]
    assert sorted(places) == list(range(n))
    return {s: [places[p] for p in range(s, n, 16)] for s in range(16) if s < n}


def test_whole_pipeline(spark, tables):
    d, _ = tables
    out = corpus_pipeline.run(spark, d)
    got = out.collect()
    assert out.columns == [*COLUMNS, "shard", "slot"] and got
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in Counter(r.shard for r in got).items())
    again = Counter(tuple(r) for r in corpus_pipeline.run(spark, d).collect())
    assert again == Counter(tuple(r) for r in got)


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def result(spark, name, *cols):
    return Counter(tuple(r) for r in __spark_entry__.queries()[name](spark, SF).select(*cols).collect())


def test_queries_without_sql(spark, small):
    import public_tokenizers
    import sentencepiece

    assert result(spark, "op4_simhash", "doc_id", "fingerprint", "component_id") == Counter(brute.near(small))
    assert result(spark, "op5_learned_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter((d, *brute.statistics(t)) for d, t in small)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    count = [(d, t, len(model.encode(t or ""))) for d, t in small]
    assert result(spark, "op7_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == Counter((d, len((t or "").encode()), n, n > 4096) for d, t, n in count)
    plain = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    assert result(spark, "op6_license_scan", "doc_id", "license") == Counter((d, next((v for k, v in plain.items() if k in (t or "")), None)) for d, t in small)
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert result(spark, "op1_quotation_linking", "conv_id", "turn", "role", "parent_turn", "clean_text") == Counter((r.conv_id, r.turn, r.role, None, r.text.strip()) for r in turns)


def test_learned_rules_on_held_out_labels(spark):
    """On labels kept from learning, the kept documents are cleaner than all, and few good ones go."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    stats = quality_rules.with_statistics(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).drop("text")
    out, rules = quality_rules.judged(stats, labels.where("doc_id % 3 != 0"))
    held = [(r.kept, r.quality) for r in out.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()]
    good = [k for k, q in held if q == 1]
    bad = [k for k, q in held if q == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.5 * len(bad), (sum(good), len(good), sum(bad), len(bad), rules)


def test_templates_save_most_on_their_own_wording():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        assert [m.name for m in scanner.notices(text)] == [name]
        assert name == max(license_scan.TEMPLATES, key=lambda n: scanner.reduction(text, n))


def test_learned_rules_against_a_plain_learner(spark, tables):
    """The query's verdicts, its rules included, against sequential covering over plain rows."""
    for d in (tables[0], SF):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
        want, rules = brute.kept_documents(docs, labels)
        got = __spark_entry__.queries()["op5_learned_rules"](spark, d)
        assert Counter((r.doc_id, r.kept) for r in got.collect()) == Counter(want) and (rules or d == SF)


def test_previous_factors_against_sql(spark, tables):
    """Columns and rows of the query are those of its SQL."""
    d, _ = tables
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    expected = con.sql(__spark_entry__.oracle_sql()["op8_previous_factors"])
    got = __spark_entry__.queries()["op8_previous_factors"](spark, d)
    assert got.columns == expected.columns
    assert Counter(map(tuple, got.collect())) == Counter(expected.fetchall())
