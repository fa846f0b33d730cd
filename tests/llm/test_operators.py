"""Each operator against its plain version, on small tables with the awkward cases."""

from __future__ import annotations

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from lamina.llm import chat_quotes, decontamination, license_scan, mixing, near_duplicates, previous_factors, quality_rules, recompression, sharding, token_counts

DOC = "doc_id long, text string, source string, key string, rk string, span string"


def corpus(seed=1, n=60):
    """Texts that share passages, copies, runs of one word, empties, nulls, repeated ids and rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    vocabulary = [word() for _ in range(40)]
    passage = [[r.choice(vocabulary) for _ in range(r.randint(20, 160))] for _ in range(6)]
    rows = []
    for i in range(n):
        words: list[str] = []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if kind < 0.4:
                words += r.choice(passage)[r.randint(0, 10) :]
            elif kind < 0.55:
                words += [r.choice(vocabulary)] * r.randint(1, 130)
            elif kind < 0.65:
                words += r.choices(vocabulary, k=2) * r.randint(20, 70)
            else:
                words += r.choices(vocabulary, k=r.randint(1, 90))
        rows.append((i, r.choice([" ", " ", "\n", "  "]).join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (None, rows[3][1]), (None, None), (4, rows[5][1]), rows[7], rows[7], (n + 3, rows[8][1]), (n + 4, "one"), (n + 5, "ONE")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s", "x", "y", "z") for d, t in rows], DOC).repartition(3)


def as_set(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_word_repeats(spark, seed):
    rows = corpus(seed)
    got = recompression.deduplicated(frame(spark, rows))
    assert as_set(got, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.repeats_words(rows))


def test_word_repeats_when_names_are_crowded(spark):
    rows = corpus(4)
    got = recompression.deduplicated(frame(spark, rows), crowd=2)
    assert as_set(got, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.repeats_words(rows))


def row_keys(spark, rows):
    """The number that orders rows of one doc_id."""
    from lamina.llm.common import row_key

    numbered = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "i int, doc_id long, text string")
    return [r[1] for r in sorted(numbered.select("i", row_key()).collect())]


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_byte_repeats(spark, crowd):
    rows = corpus(5) + [(900, "a" * 1500), (901, "ab" * 700 + "c" * 100), (902, "a" * 300), (903, "x" + "ab" * 170 + "\0" * 300), (904, "ab" * 160 + "\0" * 200)]
    got = previous_factors.deduplicated(frame(spark, rows), crowd=crowd)
    assert as_set(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.repeats_bytes(rows))
    assert as_set(got, "doc_id", "n_later", "n_earlier_docs", "first_kept_sha256") == Counter(brute.later_bytes(rows, row_keys(spark, rows)))


@pytest.mark.parametrize("seed", range(4))
def test_previous_factors_of_random_bytes(seed):
    """Lengths of factors from suffix order, against all pairs of positions."""
    import numpy as np

    r = random.Random(seed)
    text = [bytes(r.choices(b"ab" if seed % 2 else b"a\0b", [6, 1] if seed % 2 else [5, 1, 1], k=r.randint(8, 60))) for _ in range(12)]
    how = previous_factors.Lengths(size=12, floor=5, gram=2)
    # cut into runs, as buckets want them; equal runs once
    _, name, _, _, start, many, size = previous_factors.run_rows(how, [b"\1".join(text)])
    whole = b"\1".join(text)
    runs = {(int(k), whole[p : p + m]): (int(p), int(n)) for k, p, n, m in reversed(list(zip(name.view(np.int64), start, many, size)))}
    content = [c for _, c in runs]
    at, n = (np.array(x) for x in zip(*runs.values()))
    s = previous_factors.Suffixes(how, content, np.array([k for k, _ in runs], dtype=np.int64), n)
    position = at[s.which] + s.x
    got = {int(p): int(n) for p, n in zip(position, previous_factors.previous_factors(position, s.common)) if n}
    # of equal runs the first stands for all
    text, known = whole, {int(p) + x for p, m in zip(at, n) for x in range(m)}
    want = {}
    for p in known:
        best = 0
        for q in known:
            if q < p:
                n = 0
                while n < how.size and p + n < len(text) and text[p + n] == text[q + n]:
                    n += 1
                best = max(best, n)
        if best >= how.floor:
            want[p] = best
    assert want and got == want, sorted(set(got.items()) ^ set(want.items()))
    order = [text[p : p + how.size] for p in position]
    for a, b, n in zip(order, order[1:], s.common[1:]):
        assert n == 0 or a <= b


def test_repeats_in_segments(spark):
    """Texts longer than a segment give the same, wherever the cuts fall."""
    from dataclasses import replace

    rows = corpus(15, 30)
    got = recompression.deduplicated(frame(spark, rows), kind=replace(recompression.WORDS, segment=37))
    assert as_set(got, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.repeats_words(rows))
    got = previous_factors.deduplicated(frame(spark, rows), how=previous_factors.Lengths(segment=211))
    assert as_set(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.repeats_bytes(rows))
    assert as_set(got, "doc_id", "n_later", "n_earlier_docs", "first_kept_sha256") == Counter(brute.later_bytes(rows, row_keys(spark, rows)))


def test_word_hashes_in_blocks():
    import numpy as np

    from lamina.llm.repeats import word_units

    texts = [b"a few words", b"", b"  and\tsome more\n", b"x" * 50, b"a few words"]
    whole, parts = word_units(texts), word_units(texts, block=7)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1]) and list(whole[1]) == [3, 3, 6, 7, 10]
    assert np.array_equal(whole[0][:3], whole[0][7:])


def test_byte_repeats_keep_the_first(spark):
    rows = [(1, "x" + "abcdefghij" * 60), (2, "abcdefghij" * 60 + "tail"), (3, "short")]
    got = {r.doc_id: r for r in previous_factors.deduplicated(frame(spark, rows), remove="later").collect()}
    # the passage repeats itself from its tenth byte on
    assert got[1].n_later == 590 and bytes(got[1].kept) == b"xabcdefghij" and got[1].n_earlier_docs == 0
    assert got[2].n_later == got[2].n_earlier_docs == 600 and bytes(got[2].kept) == b"tail" and got[2].n_removed == 600


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_near_duplicates(spark, crowd):
    rows = corpus(6)
    r = random.Random(9)
    base = [f"w{r.randint(0, 500)}" for _ in range(300)]
    for i in range(25):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randint(0, 299)] = "changed"
        rows.append((1000 + i, " ".join(words)))
    got = near_duplicates.labelled(frame(spark, rows), crowd=crowd)
    assert as_set(got, "doc_id", "fingerprint", "component_id") == Counter(brute.near(rows))
    # with one row per doc_id, names of components are distinct
    single = list({d: (d, t) for d, t in rows if d is not None}.values())
    kept = near_duplicates.deduplicated(frame(spark, single + single[:5]))
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute.near(single)} and kept.count() == len({c for _, _, c in brute.near(single)})


def test_long_lists_look_their_neighbours_up():
    """The same pairs as by comparing all, in a list whose fingerprints share five bytes."""
    import numpy as np

    r = random.Random(4)
    for positions in ((0, 1, 2, 3, 4), (1, 3, 4, 6, 7)):
        free = [p for p in range(8) if p not in positions]
        base = r.randrange(1 << 64)
        some = {0}
        while len(some) < 500:
            x = r.choice(sorted(some)) if r.random() < 0.6 else r.randrange(1 << 24)
            some.add(x ^ sum({1 << r.randrange(24) for _ in range(r.randint(1, 4))}))
        fp = np.array([base ^ sum((x >> 8 * i & 255) << 8 * p for i, p in enumerate(free)) for x in some], dtype=np.uint64)
        pairs = lambda found: {tuple(sorted(p)) for p in zip(*(x.tolist() for x in found))}
        want = pairs(near_duplicates.close_pairs(fp, np.zeros(len(fp), dtype=np.int64)))
        assert want and pairs(near_duplicates.looked_up(fp, positions)) == want


def test_statistics(spark):
    rows = corpus(7) + [(500, "a #*\nb\n\nb\nb $$ |x>"), (501, "q w e r t y u i " * 9)]
    got = quality_rules.with_statistics(frame(spark, rows))
    assert as_set(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter((d, *brute.statistics(t)) for d, t in rows)


def test_learned_rules_find_a_planted_threshold(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) + ("###" if bad else "") for _ in range(60)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    stats = quality_rules.with_statistics(frame(spark, rows))
    out, found = quality_rules.judged(stats, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int"))
    assert found.rules and found.rules[0].conditions[0][0] in ("symbol_rate", "mean_word")
    assert {r.doc_id for r in out.where("not kept").collect()} == set(range(0, 400, 4))
    nothing, none = quality_rules.judged(stats, spark.createDataFrame([], "doc_id long, quality int"))
    assert not none.rules and nothing.where("kept").count() == 400


def labelled_rows(spark, rows):
    """(quality, mean_word, symbol_rate) as statistics of texts of 100 words."""
    data = [(i, y, 100, m // 10, m // 10 * s // 1000, 0, 0) for i, (y, m, s) in enumerate(rows)]
    return spark.createDataFrame(data, "_id long, quality long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


@pytest.mark.parametrize("bad", [40, 20])
def test_learned_rules_find_a_rare_class(spark, bad):
    r = random.Random(11)
    rows = [(1, r.randint(4000, 6000), 0) for _ in range(4000)] + [(0, r.randint(6200, 8000), 0) for _ in range(bad)]
    found = quality_rules.learned(labelled_rows(spark, rows))
    judged = labelled_rows(spark, rows).withColumn("label", found.column())
    assert judged.where("quality = 0 and label = 1").count() <= bad // 10 and judged.where("quality = 1 and label = 0").count() == 0


def test_learned_rules_go_on_after_a_failed_one(spark):
    """A large class that no threshold tells apart well comes first; the clean one behind it is still learned."""
    r = random.Random(12)
    rows = [(r.choice([0, 1]), r.randint(6000, 7000), 0) for _ in range(3000)] + [(1, r.randint(4000, 7000), 0) for _ in range(3000)]
    rows += [(0, r.randint(4000, 7000), 300) for _ in range(300)]
    found = quality_rules.learned(labelled_rows(spark, rows))
    assert any(c[0] == "symbol_rate" for rule in found.rules for c in rule.conditions)
    judged = labelled_rows(spark, rows).withColumn("label", found.column())
    assert judged.where("quality = 0 and n_symbols > 0 and label = 1").count() == 0


def test_decontamination(spark):
    rows = corpus(8)
    words = [t.split() for _, t in rows if t and len(t.split()) > 80]
    items = [(i, " ".join(w[10 : 10 + 5 * (i + 1)])) for i, w in enumerate(words[:9])] + [(50, None), (51, ""), (52, "one"), (53, items_text := " ".join(words[0][5:60])), (54, items_text), (None, "é e")]
    rows += [(700, "ONE"), (701, "x, One. y"), (702, items_text.upper() + " tail")]
    got = decontamination.per_row(decontamination.judged(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")))
    assert as_set(got, "id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == Counter(brute.contaminated(rows, items))
    left = decontamination.decontaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert left.count() == sum(not x[-1] for x in brute.contaminated(rows, items))
    assert decontamination.judged(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus(9) + [(800 + i, t) for i, t in enumerate([" ", "  ", "   a", "a  b ", "▁", "▁a", "a▁ b", " ▁ ", "<s> </s>", "é　ﬁ\n\n\tx", "x" * 300, "a\r\n b\r"])]
    got = token_counts.counted(frame(spark, rows), table_size=20)
    assert as_set(got, "doc_id", "n_tokens") == Counter((d, len(model.encode(t or ""))) for d, t in rows)


def test_frequent_pre_tokens_of_all_rows(spark):
    """Those of the last rows count like those of the first; the table is never larger than asked for."""
    rows = [(i, "alpha beta rare%d" % i) for i in range(400)] + [(i, "omega") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert set(token_counts.frequent(df, "text", 50, 3)) == {"alpha", "beta", "omega"}
    assert token_counts.frequent(df, "text", 50, 1) == ["omega"] and len(token_counts.frequent(df, "text", 300, 100)) <= 100
    assert token_counts.frequent(df.limit(0), "text", 50, 3) == []


@pytest.mark.parametrize("n", [0, 1, 2, 5, 16, 17, 100, 257])
def test_sharding(spark, n):
    rows = [(i % 90 if i % 11 else None, str(i % 7)) for i in range(n)]
    got = sharding.sharded(frame(spark, rows), "doc_id", "text", shards=16).collect()
    assert len(got) == n
    sizes = Counter(r.shard for r in got)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(k)) for s, k in sizes.items())
    assert not sizes or max(sizes.values()) - min(sizes.get(i, 0) for i in range(16)) <= 1
    again = sharding.sharded(frame(spark, rows[::-1]), "doc_id", "text", shards=16)
    assert as_set(again, "doc_id", "text", "shard", "slot") == Counter((r.doc_id, r.text, r.shard, r.slot) for r in got)


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i if i % 50 else None, " ".join(["w"] * r.randint(0, 40)), r.choice(["a", "a", "a", "b", "c", None]), "x", "y", "z") for i in range(600)]
    rows += [(1, None, "tiny", "x", "y", "z"), (2, "one", "tiny", "x", "y", "z")]
    df = spark.createDataFrame(rows, DOC)
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    total = sum(g["size"] for g in got)
    per = {}
    for g in got:
        per.setdefault(g.source, [g.source_size, g.target, 0])[2] += g.taken
        assert g.taken == g["size"] * g.copies and 0 <= g.copies <= 3
    assert abs(sum(t for _, t, _ in per.values()) - total) < 1e-6
    assert per["tiny"][1] == 3 and per["tiny"][2] <= 3
    assert all(abs(taken - target) <= 41 and target <= 3 * size for size, target, taken in per.values())
    assert sum(x[2] for x in per.values()) <= total
    again = mixing.mixed(df.repartition(5))
    assert as_set(again, "doc_id", "size", "source", "taken") == Counter((g.doc_id, g["size"], g.source, g.taken) for g in got)
    assert mixing.expanded(df).count() == sum(g.copies for g in got)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_license_scan(spark):
    rows = [
        (1, "intro text here\nReleased under the MIT License.\nmore"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "Licensed under CC BY-SA 4.0."),
        (4, "This work is licensed under the GNU General Public Licence, version 3."),
        (5, "the licensing office is closed"),
        (6, None), (7, ""), (None, "x " * 9000 + license_scan.TEMPLATES["Apache-2.0-header"] + " y" * 9000),
    ]
    got = {r.doc_id: r for r in license_scan.scanned(frame(spark, rows)).collect()}
    assert [got[i].license for i in (1, 2, 3, 4, 5, 6, 7)] == ["MIT", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GPL-3.0", None, None, None]
    assert got[1].n_missing == 0 and got[4].n_missing == 1 and got[5].n_blocks == 1
    assert got[None].license == "Apache-2.0-header"



@pytest.mark.parametrize("prefix", ["", "# ", " * ", "        // ", "REM "])
def test_license_scan_of_wrapped_notices(spark, prefix):
    import textwrap

    names = sorted(license_scan.TEMPLATES)
    code = "import os\nprint(os.name)\n\n"
    rows = [(i, code + textwrap.indent(textwrap.fill(license_scan.TEMPLATES[n], width, break_long_words=False, break_on_hyphens=False), prefix) + "\n\n" + code) for i, n in enumerate(names * 2) for width in [76 if i < len(names) else 40]]
    got = {r.doc_id: r for r in license_scan.scanned(frame(spark, rows)).collect()}
    assert [got[i].license for i in range(len(rows))] == names * 2
    assert all(r.n_missing == 0 and r.n_matches == 1 for r in got.values())


def edited(words, r, share):
    """A notice with a share of its words dropped, changed or followed by another one."""
    out = list(words)
    for i in r.sample(range(1, len(out) - 1), int(share * len(out))):
        out[i] = r.choice(["", "changed", out[i] + " indeed"][: 3 if share < 0.1 else 2])
    return [w for w in out if w]


def test_license_scan_against_planted_notices(spark):
    """Notices with up to a tenth of their words edited are found wherever they stand; with a third, none is."""
    import textwrap

    r = random.Random(17)
    names = ["BSD-3-Clause", "GPL-3.0-header", "MIT-text", "LGPL-3.0", "MPL-2.0", "CC-BY-4.0"]
    filler = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "software", "license", "the", "of"]) for _ in range(r.randint(5, 60)))
    rows, want = [], {}
    for i in range(40):
        planted, parts = r.sample(names, r.randint(0, 3)), [filler()]
        for n in planted:
            notice = " ".join(edited(license_scan.TEMPLATES[n].split(), r, r.choice([0, 0.04, 0.08])))
            parts += [textwrap.indent(textwrap.fill(notice, r.choice([40, 72, 10_000])), r.choice(["", "# ", " * "])), filler()]
        if i % 4 == 0:
            parts += [" ".join(edited(license_scan.TEMPLATES[r.choice(names)].split(), r, 0.34)), filler()]
        rows.append((i, r.choice(["\n\n", "\n\n\n"]).join(parts)))
        want[i] = sorted(planted)
    rows += [rows[5], rows[5]]
    got = license_scan.scanned(frame(spark, rows)).collect()
    assert Counter((g.doc_id, tuple(g.licenses)) for g in got) == Counter((d, tuple(want[d])) for d, _ in rows)


def test_license_scan_of_long_templates(spark):
    """A whole license text as template is found as a whole, though most of it is far from any cue."""
    r = random.Random(3)
    body = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(900))
    templates = {"long": "This license text goes on. " + body, **license_scan.TEMPLATES}
    got = license_scan.scanned(frame(spark, [(1, "head\n" + templates["long"] + "\ntail"), (2, body[:600])]), templates=templates).orderBy("doc_id").collect()
    assert [g.licenses for g in got] == [["long"], []] and got[0].n_missing == 0 and got[0].n_extra == 0


def test_license_scan_of_scattered_words(spark):
    text = "We released it.\nIt went under,\nas the people of that time said in letters\nof MIT to each other.\nNo license."
    assert license_scan.scanned(frame(spark, [(1, text)])).first().license is None


def test_license_scan_names_all(spark):
    t = license_scan.TEMPLATES
    rows = [
        (1, "Released under the MIT License. Docs: Licensed under CC BY-SA 4.0."),
        (2, t["MIT"] + "\nsome words\n" + t["GPL-3.0"]),
        (3, " ".join(t[k] for k in sorted(t)[1:])),
        (4, "\n".join([t["MIT"]] * 30 + [t["MPL-2.0"]])),
        (5, "no license"),
    ]
    got = {r.doc_id: r for r in license_scan.scanned(frame(spark, rows)).collect()}
    assert [got[i].licenses for i in (1, 2, 3, 4, 5)] == [["CC-BY-SA-4.0", "MIT"], ["GPL-3.0", "MIT"], sorted(t)[1:], ["MIT", "MPL-2.0"], []]
    assert [got[i].n_matches for i in (1, 2, 3, 4, 5)] == [2, 2, len(t) - 1, 31, 0]


def test_quotation_linking(spark):
    rows = [
        (1, 0, "a", "Hello there my friends.\nSecond line of text."),
        (1, 1, "b", "> Hello there, my friends.\nNice to meet you all."),
        (1, 2, "c", "On Monday a wrote:\n>> Hello there my   friends.\n> Nice to meet you all.\nAgreed with both of you."),
        (1, 3, "a", "no quotes in this one"),
        (1, 4, "b", "> second line of text\nanswer to the first"),
        (1, 5, "b", "> never said by anyone\nstill here"),
        (2, 0, "a", None), (2, 1, "a", ""), (2, 1, "a", ""), (None, 3, "a", "> x"), (3, None, "a", "text"), (4, 9, "a", "> nice to meet you all"),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, conv string")
    got = chat_quotes.formatted(df)
    assert got.count() == len(rows) and "conv" in got.columns
    one = {r.turn: r for r in got.where("conv_id = 1").collect()}
    assert [one[t].parent_turn for t in range(6)] == [None, 0, 1, None, 0, None]
    assert [one[t].depth for t in range(6)] == [0, 1, 2, 0, 1, 0]
    assert [t for t in sorted(one, key=lambda t: one[t].position)] == [0, 1, 4, 2, 3, 5]
    assert one[2].clean_text == "Agreed with both of you." and one[2].max_level == 2 and one[2].n_quotes == 2
    assert [r.position for r in got.where("conv_id = 2").orderBy("position").collect()] == [0, 1, 2]
    assert got.where("conv_id = 4").first().parent_turn is None
    assert chat_quotes.formatted(df.limit(0)).count() == 0


def chat(spark, *texts):
    """The messages of one conversation, by turn."""
    rows = [(1, i, "a", t) for i, t in enumerate(texts)]
    got = chat_quotes.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return [r for r in got.orderBy("turn").collect()]


def test_short_quotes_link(spark):
    got = chat(spark, "Yes.", "> Yes.\nso be it", "你好吗", "> 你好吗\n很好", "👍", "> 👍\nfine with me", "> \nnothing quoted", "ok", "> ok\nfirst", "ok", "> ok\nsecond")
    assert [r.parent_turn for r in got] == [None, 0, None, 2, None, 4, None, None, 7, None, 9]


def test_long_quotes_link_before_short_ones(spark):
    whole = "a line that is long enough\nok"
    got = chat(spark, whole, "another long line here\nok", "> a line that is long enough\n> ok\nanswer", "> a line that is long enough\n> never said\n\n> ok\nanswer")
    assert [r.parent_turn for r in got] == [None, None, 0, 0]
    got = chat(spark, whole, "nothing in it", "ok", "> a line that is long enough\n> ok\nanswer")
    assert got[3].parent_turn == 0


def test_nested_quotes_are_linked(spark):
    got = chat(spark, "the very first message", "> the very first message\nthe second message", ">> the very first message\n> the second message\nthe third message", ">> the very first message\nonly the deeper level", "> the second message\ntext\n> the third message\nboth", "> the second message\n> the third message\nadjacent")
    assert [r.parent_turn for r in got] == [None, 0, 1, 0, 2, 2]
    assert [sorted((q.level, q.source) for q in r.quotes) for r in got] == [[], [(1, 0)], [(1, 1), (2, 0)], [(2, 0)], [(1, 1), (1, 2)], [(1, 1), (1, 2)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_against_a_plain_linker(spark, seed):
    """Random chats with nested, edited and short quotes, announcements, blank lines, parts, nulls and copies."""
    r = random.Random(seed)
    say = ["Hello there, all of you!", "a second thing to say", "ok", "Yes.", "你好吗", "...", "", "  ", "Ünïcode wörds here", "one more line of text"]
    rows = []
    for conv in (1, 2, None):
        told: list[str] = []
        for turn in range(25):
            lines: list[str] = []
            for _ in range(r.randint(0, 3)):
                if r.random() < 0.2:
                    lines.append(r.choice(["On Monday a wrote:", "on and on he wrote: ", "She wrote:"]))
                quoted = r.choice(told).split("\n") if told and r.random() < 0.8 else r.sample(say, 2)
                mark = r.choice(["> ", ">", ">> ", " > > ", ">\t"])
                lines += [mark + (x.upper() if r.random() < 0.2 else x) for x in quoted[r.randint(0, 1) :]]
                lines += r.choices(say, k=r.randint(0, 3))
            text = r.choice(["\n", "\n", "\r\n"]).join(lines + r.choices(say, k=r.randint(0, 2)))
            told.append(text)
            rows.append((conv, turn if r.random() < 0.95 else None, r.choice(["a", "b", None]), text if r.random() < 0.95 else None))
    rows += [rows[3], rows[3], (1, 5, "c", "> ok\na part of one message")]
    names = "conv_id long, turn long, role string, text string"
    got = chat_quotes.formatted(spark.createDataFrame(rows, names).repartition(3))
    got = [(g.conv_id, g.turn, g.n_quotes, g.max_level, tuple(map(tuple, g.quotes)), g.parent_turn, g.thread_turn, g.depth, g.position, g.clean_text) for g in got.collect()]
    want = brute.conversations(rows)
    assert any(w[7] > 2 for w in want)
    drop = lambda w: w[:8] + w[9:]
    assert Counter(map(drop, got)) == Counter(map(drop, want))
    place = lambda w: (w[0], w[8], w[6], w[7], w[1], w[9])
    assert Counter(map(place, got)) == Counter(map(place, want))


def test_quotes_of_alternating_levels_take_time_by_the_line(spark):
    """A message of many short passages costs no more a line than a short one."""
    import time

    def seconds(n):
        text = "\n".join("> a quoted line" if i % 2 else "an answer" for i in range(n))
        df = spark.createDataFrame([(1, 0, "a", "a quoted line")] + [(1, 1 + i, "b", text) for i in range(32_000 // n)], "conv_id long, turn long, role string, text string")
        began = time.perf_counter()
        assert chat_quotes.formatted(df).agg(F.max("n_quotes")).first()[0] == n // 2
        return time.perf_counter() - began

    seconds(1_000)
    assert seconds(32_000) < 4 * seconds(500)


def test_long_reply_chains(spark):
    """A conversation longer than a block of turns, each message quoting the one before."""
    n = chat_quotes.BLOCK + 40
    rows = [(7, i * 3, "a", (f"> message number {i - 1} of this chat\n" if i else "") + f"message number {i} of this chat") for i in range(n)]
    got = chat_quotes.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.agg(F.max("depth"), F.max("position"), F.countDistinct("thread_turn")).first() == (n - 1, n - 1, 1)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item"), (3, None), (4, "")]


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


@pytest.mark.parametrize(
    "f",
    [
        recompression.deduplicated, previous_factors.deduplicated, near_duplicates.labelled, near_duplicates.deduplicated, token_counts.counted, license_scan.scanned, quality_rules.with_statistics,
        lambda d: quality_rules.kept_rows(d, labels(d.sparkSession, [(1, 0), (2, 1)])), lambda d: decontamination.decontaminated(d, benchmark(d.sparkSession)), mixing.mixed, mixing.expanded, lambda d: sharding.sharded(d, "doc_id", "text"),
    ],
)
def test_empty_tables(spark, f):
    assert f(frame(spark, [])).count() == 0


def test_empty_side_tables(spark):
    """Without labels the base rule decides, without items nothing is contaminated."""
    rows = [(1, "a word or two " * 12), (2, " ".join(f"w{i}" for i in range(30))), (3, "few words"), (4, ""), (5, None)]
    df = frame(spark, rows)
    assert sorted(r.doc_id for r in quality_rules.kept_rows(df, labels(spark)).collect()) == [d for d, t in rows if not brute.statistics(t)[-1]]
    assert decontamination.decontaminated(df, benchmark(spark, [])).count() == 5
    assert decontamination.decontaminated(df, benchmark(spark, [(1, None), (2, " ,. ")])).count() == 5


def test_very_long_texts(spark):
    """One text of 60,000 words beside short ones, against the plain versions."""
    import public_tokenizers
    import sentencepiece

    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(3_000)]
    words = r.choices(vocabulary, k=60_000)
    words[40_000:40_100] = words[100:200]
    words[50_000:50_000] = ITEMS[0][1].split() + license_scan.TEMPLATES["MPL-2.0"].split()
    long = "\n".join(" ".join(words[i : i + 50]) for i in range(0, len(words), 50))
    rows = [(1, long), (2, long.upper()), (3, "short item"), (4, None), (5, "x" * 200_000), (6, " ".join(words[:300]))]
    df = frame(spark, rows)
    assert as_set(near_duplicates.labelled(df), "doc_id", "fingerprint", "component_id") == Counter(brute.near(rows))
    got = quality_rules.with_statistics(df)
    assert as_set(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter((d, *brute.statistics(t)) for d, t in rows)
    found = {g.doc_id: g.licenses for g in license_scan.scanned(df).collect()}
    assert found == {1: ["MPL-2.0"], 2: ["MPL-2.0"], 3: [], 4: [], 5: [], 6: []}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert as_set(token_counts.counted(df), "doc_id", "n_tokens") == Counter((d, len(model.encode(t or ""))) for d, t in rows)
    hit = decontamination.per_row(decontamination.judged(df, benchmark(spark)))
    assert as_set(hit, "id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == Counter(brute.contaminated(rows, ITEMS))
    assert as_set(recompression.deduplicated(df), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.repeats_words(rows))


#: Names that operators use themselves or give to results, and one that must be quoted.
CLASHES = ["size", "copies", "SOURCE_SIZE", "target", "n_tokens", "N_Words", "word_chars", "shard", "slot", "place", "row", "_row", "key", "id", "doc", "rk", "fp", "w", "kept", "base_failed", "asked_key", "order", "p", "a", "start", "sum", "copy", "_part", "_at", "_start", "a.b"]


@pytest.mark.parametrize(
    "f, results",
    [
        (lambda d: sharding.sharded(d, "doc_id", "text"), "doc_id text shard slot"),
        (recompression.deduplicated, "doc_id n_words n_removed kept_sha256"),
        (previous_factors.deduplicated, "doc_id n_bytes n_removed n_later kept_sha256"),
        (near_duplicates.labelled, "doc_id fingerprint component_id"),
        (near_duplicates.deduplicated, "doc_id text"),
        (quality_rules.with_statistics, "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed"),
        (lambda d: quality_rules.kept_rows(d, d.sparkSession.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")), "doc_id text"),
        (license_scan.scanned, "doc_id n_blocks n_matches license"),
        (token_counts.counted, "doc_id text n_tokens"),
        (lambda d: decontamination.decontaminated(d, d.sparkSession.createDataFrame([(1, "one")], "item_id long, text string")), "doc_id text"),
        (lambda d: decontamination.per_row(decontamination.judged(d, d.sparkSession.createDataFrame([(1, "one")], "item_id long, text string"))), "id n_words n_hit contaminated"),
        (mixing.mixed, "doc_id source size target copies taken"),
        (mixing.expanded, "doc_id text source"),
    ],
)
def test_extra_columns_with_clashing_names(spark, f, results):
    """They change no result; a column with the name of a result gives way, the others are carried along."""
    rows = corpus(21, 20)
    plain = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    wide = plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES], F.create_map(F.lit("k"), F.lit(1)).alias("map"), F.lit(None).alias("nothing"))
    got, want = f(wide), f(plain)
    assert as_set(got, *results.split()) == as_set(want, *results.split())
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    carried = [c for c in CLASHES if c in got.columns and c.lower() not in {x.lower() for x in want.columns}]
    if "text" in results.split():
        assert len(carried) >= len(CLASHES) - 8
    for c in carried:
        assert got.where(F.col(f"`{c}`") != f"own {c}").isEmpty() or "text" not in results.split()


def test_conversations_with_clashing_names(spark):
    rows = [(1, 0, "a", "the first message"), (1, 1, "b", "> the first message\nand an answer"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ["conv", "source", "root", "depth", "DEPTH2", "n", "first", "level", "quoted", "quotes", "_row", "p", "position", "h", "a.b"]
    wide = df.select("*", *[F.lit("own").alias(c) for c in names], F.create_map(F.lit("k"), F.lit(1)).alias("map"))
    got, want = chat_quotes.formatted(wide), chat_quotes.formatted(df)
    assert as_set(got, *[c for c in want.columns if c != "quotes"]) == as_set(want, *[c for c in want.columns if c != "quotes"])
    assert got.where("source = 'own' and conv = 'own' and root = 'own'").count() == 3 and "a.b" in got.columns
