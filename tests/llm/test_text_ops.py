"""Line dedup, license scan, personal data, quality."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from factloom.llm import license, linededup, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, hit int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "old", 1) for d, t in rows], DOCS)


def unique(i, n=6):
    """Words of letters alone that no other number has."""
    name = "".join(chr(97 + int(c)) for c in str(i))
    return " ".join(f"{name}z{chr(97 + k % 20)}{'y' * (k // 20 % 5)}" for k in range(n))


# line dedup


def test_recurring_lines_go_and_copies_stay(spark):
    rows = [(i, f"{unique(i)}\nPlease read our terms of use carefully today\n{unique(i + 1000)}\nOrder number {i}77 was shipped to you by post") for i in range(12)]
    rows += [(100 + k, "a very special copy of one\nsecond line of the same copy") for k in range(8)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "short"), (None, f"{unique(9999)}\nPlease read our terms of use carefully today")]
    got = linededup.dedup_lines(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "hit", "n_lines", "n_dropped"]
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == len(rows)
    for i in range(12):
        assert by[i].text == f"{unique(i)}\n{unique(i + 1000)}" and by[i].n_dropped == 2 and by[i].n_chars == len(by[i].text)
    assert by[100].text == "a very special copy of one\nsecond line of the same copy"
    assert (by[200].text, by[200].n_lines) == (None, 0) and by[201].text == "" and by[202].text == "\n\n" and by[203].text == "short"
    assert by[None].text == unique(9999)


def test_many_shared_lines_and_large_groups_of_copies_keep_no_recurring_line(spark):
    shared = [f"Shared {unique(k)} line of this site" for k in range(500, 508)]
    passage = f"This passage {unique(700, 12)} is in different texts"
    rows = [(i, "\n".join([*shared[:4], unique(i + 1000), *shared[4:]])) for i in range(30)]
    rows += [(100 + i, f"{passage}\n{unique(i + 2000)}") for i in range(6)] + [(200 + k, f"{passage}\n{unique(3000)}") for k in range(60)]
    by = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert [by[i] for i in range(30)] == [unique(i + 1000) for i in range(30)]
    assert [by[100 + i] for i in range(6)] == [unique(i + 2000) for i in range(6)]
    assert {by[200 + k] for k in range(60)} == {unique(3000)}


def test_the_count_that_drops_a_line_is_fixed(spark):
    passage = f"This passage {unique(700, 50)} is in three texts"
    rows = [(i, f"{passage}\n{unique(i + 2000)}") for i in range(3)] + [(10 + i, f"read more here\n{unique(i + 4000)}") for i in range(20)]
    rows += [(5000 + i, unique(i + 5000)) for i in range(4000)]
    near = [unique(900 + k, 12) for k in range(6)]
    rows += [(100 + k, "\n".join([*near[:k], near[k].replace(" ", " other ", 1), *near[k + 1 :]])) for k in range(6)]
    by = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert [by[i] for i in range(3)] == [unique(i + 2000) for i in range(3)]
    assert [by[10 + i] for i in range(20)] == [unique(i + 4000) for i in range(20)]
    assert [by[100 + k] for k in range(6)] == [dict(rows)[100 + k] for k in range(6)]


SPACE = "\x20\x09-\x0d"


def brute_lines(texts, depth=3, documents=3, similarity=0.7, short=5, short_documents=20, levels=3):
    """The rule again over plain Python sets; hashes only order leaves."""
    toks = lambda line: re.findall(f"[^{SPACE}]+", line)
    chain = lambda n, lead: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(lead.encode(), xxhash.xxh64_intdigest(n.to_bytes(4, "little"), 42)))

    def lead(line):
        got = re.match(f"[{SPACE}]*((?:[^{SPACE}]+[{SPACE}]*){{0,{depth}}})", line)[1]
        return re.sub(f"[^{SPACE}]*[0-9][^{SPACE}]*", "<*>", got.rstrip(" "))

    leaf = lambda line: chain(len(toks(line)), lead(line)) if toks(line) else None
    different = {t: t.split("\n") for t in texts if t is not None}
    leads, tails = defaultdict(set), defaultdict(set)
    for t, lines in different.items():
        for line in lines:
            if toks(line):
                leads[lead(line)].add(t)
                tails[lead(line[::-1])].add(t)
    ends = {}
    for t, lines in different.items():
        leaves = {leaf(line) for line in lines} - {None}
        if leaves:
            own = any(toks(line) and leads[lead(line)] == {t} and tails[lead(line[::-1])] == {t} for line in lines)
            ends[t] = (t, t) if own else (min(leaves), max(leaves))

    def kinds(of):
        return min(len({e[0] for e in of}), len({e[1] for e in of}))

    rows = [(t, different[t]) for t in texts if t in ends]
    by_line, by_leaf, count = defaultdict(set), defaultdict(set), Counter()
    for t, lines in rows:
        for line in lines:
            if toks(line):
                by_line[line].add(ends[t])
                by_leaf[leaf(line)].add(ends[t])
    seen = Counter((line, t, e) for t, e in ends.items() for line in set(different[t]))
    for t, lines in rows:
        for line in set(lines):
            count[line] += 1
    drop = {x for x, of in by_line.items() if kinds(of) >= documents and (len(toks(x)) >= short or kinds(of) >= short_documents)}
    parts = {}
    for x in by_line:
        if len(toks(x)) >= short and kinds(by_leaf[leaf(x)]) >= documents:
            parts.setdefault((leaf(x),), set()).add(x)
    fit = {}
    for _ in range(levels):
        below = {}
        for part, members in parts.items():
            total, have = sum(count[x] for x in members), Counter()
            for x in members:
                for at, w in enumerate(toks(x)):
                    have[at, w] += count[x]
            for x in members:
                spots = list(enumerate(toks(x)))
                if sum(2 * have[s] > total for s in spots) / len(spots) >= similarity:
                    fit.setdefault(part, set()).add(x)
                    continue
                rest = [(have[s], -s[0], s[1]) for s in spots if 2 * have[s] <= total and s[0] >= depth and have[s] >= documents]
                if rest:
                    below.setdefault((*part, max(rest)[1:]), set()).add(x)
        parts = below
    for members in fit.values():
        if kinds({e for x in members for e in by_line[x]}) >= documents:
            drop |= members
    assert seen
    return {t: "\n".join(x for x in lines if x not in drop) for t, lines in different.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_line_dedup_equals_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = brute_lines([r.text for r in docs.collect()])
    for options in ({}, {"most_keys": 0}):
        got = linededup.dedup_lines(docs, **options).collect()
        before = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.text == want[before[r.doc_id]] for r in got if before[r.doc_id] is not None)
        assert any(r.n_dropped for r in got)


def recurring_lines(n, seed):
    """Documents with lines of five templates in one leaf, two of them with fields of few values; and the lines planted."""
    rng = random.Random(seed)
    kinds = ["Order number {0} was shipped to {1} by post this week", "Order number {0} will be billed by card {1} next month", "Order number {0} can not be found in {1} any more", "Order number {0} has come back from {1} without a name", "Order number {0} stands open since {1} in our own books"]
    rows, planted = [], {}
    for i in range(n):
        lines = [unique(seed * 10**6 + i * 3), unique(seed * 10**6 + i * 3 + 1, 9)]
        if i % 3 == 0:
            lines.insert(1, kinds[rng.randrange(5)].format(rng.randrange(10**6), rng.choice(["Ann", "Bob", "Cid", "Dan", unique(i, 1)])))
            planted[i] = lines[1]
        rows.append((i, "\n".join(lines)))
    return rows, planted


@pytest.mark.parametrize("n", [150, 600, 2400])
def test_templates_of_one_leaf_are_told_apart_at_any_size(spark, n):
    rows, planted = recurring_lines(n, n)
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert sum(planted[i] not in got[i].text for i in planted) >= 0.95 * len(planted)
    assert sum(got[i].n_dropped for i in got) <= len(planted)


def test_clashing_columns_of_line_dedup(spark):
    df = spark.createDataFrame([(i, f"{unique(i)}\nPlease read our terms of use carefully today", i, "b", "d", "o", 1) for i in range(5)] + [(None, None, 9, "b", "d", "o", 1)] * 2, "doc_id long, text string, _id int, _body string, _drop string, _own string, `a.b` int")
    for options in ({}, {"most_keys": 0}):
        got = linededup.dedup_lines(df, **options)
        assert got.columns == [*df.columns, "n_lines", "n_dropped"]
        assert sorted((r._id, r._body, r._drop, r._own, r["a.b"], r.n_dropped) for r in got.collect()) == [*((i, "b", "d", "o", 1, 1) for i in range(5)), *[(9, "b", "d", "o", 1, 0)] * 2]


def test_line_dedup_of_tables_without_lines(spark):
    assert linededup.dedup_lines(frame(spark, [])).collect() == []
    assert [r.text for r in linededup.dedup_lines(frame(spark, [(1, None)])).collect()] == [None]


def test_repeated_rows_and_very_long_texts(spark):
    long = "\n".join(unique(k) for k in range(3000))
    got = linededup.dedup_lines(frame(spark, [(1, long), (1, long)])).collect()
    assert [r.text for r in got] == [long, long] and got[0].n_lines == 3000


# license scan


def brute_licenses(text, n=5, part=64):
    def grams(t):
        w = [x for x in re.split(r"[^\w]+|_+", (t or "").lower()) if x]
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    own, out = set(grams(text)), {}
    for name, t in license.templates():
        every = grams(t)
        cuts = [*range(0, max(1, len(every) // part) * part, part), len(every)]
        for lo, hi in zip(cuts, cuts[1:]):
            some = set(every[lo:hi])
            if some and len(some & own) >= 0.8 * len(some):
                out[name] = max(out.get(name, 0), len(some & own) / len(some))
    return out


def test_licenses_equal_brute_force(spark):
    known = dict(license.templates())
    mit, bsd = known["MIT"], known["BSD-3-Clause"]
    texts = [f"{unique(1)} {mit} {unique(2)}", f"x {bsd.replace('with or without', 'WITH, or without')}!", mit.replace("charge", "cost"), "Released under the MIT License.", "released under", None, "", f"{unique(3, 40_000)} Licensed under CC BY-NC 4.0. {mit}", bsd[: len(bsd) // 2], f"{mit} {bsd}", known["GPL-3"], known["Apache-2.0"][2000:6000]]
    got = {r.doc_id: {m.template: m.containment for m in r.matches} for r in license.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: brute_licenses(t) for i, t in enumerate(texts)}
    assert license.scan(frame(spark, [])).collect() == []


def test_damaged_licenses_are_found_where_enough_is_left(spark):
    """Recall against brute force over passages and notices with words changed at random."""
    rng, texts = random.Random(11), []
    known = license.templates()
    for i in range(400):
        words = known[i % len(known)][1].split()
        lo = rng.randrange(max(1, len(words) - 140))
        words = words[lo : lo + 140]
        for at in rng.sample(range(len(words)), int(len(words) * rng.choice([0, 0.01, 0.03]))):
            words[at] = "changed"
        texts.append(f"{unique(i, 20)} {' '.join(words)} {unique(i + 5000, 20)}")
    got = {(r.doc_id, m.template) for r in license.scan(frame(spark, list(enumerate(texts)))).collect() for m in r.matches}
    want = {(i, name) for i, t in enumerate(texts) for name in brute_licenses(t)}
    assert len(want) > 150 and got <= want and len(got) >= 0.99 * len(want)


def test_license_rows_repeat(spark):
    got = license.scan(frame(spark, [(None, "Released under the MIT License."), (1, "x"), (1, "x")])).collect()
    assert sorted((str(r.doc_id), len(r.matches)) for r in got) == [("1", 0), ("1", 0), ("None", 1)]


# quality


def test_quality_learns_shapes_and_ignores_other_columns(spark):
    good = [(i, f"The {unique(i)} is a normal sentence. And so is this one, of course.") for i in range(200)]
    bad = [(1000 + i, " ".join(f"{w.upper()}!!" for w in unique(i, 12).split())) for i in range(100)]
    rows = good + bad + [(5000, None), (5001, ""), (5002, "word " * 50_000), (None, "text")]
    labels = spark.createDataFrame([(d, int(d < 1000), 0, 1.0) for d, _ in good + bad] + [(None, 1, 0, 1.0), (7, None, 0, 1.0)], "doc_id long, quality int, toxic int, score double")
    docs = frame(spark, rows)
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [d for d, _ in good + bad if quality.python_held_out(d)]
    assert held and all(got[d].predicted == int(d < 1000) for d in held)
    assert got[5000].score == got[5001].score
    assert quality.score(frame(spark, []), model).collect() == []


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = frame(spark, [(1, "a b")])
    assert [r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()] == [0.5]


def test_dual_coordinate_descent_separates():
    import numpy as np

    rows = [np.array([0, 2]), np.array([1, 2])] * 20
    y = np.array([1.0, -1.0] * 20)
    w = quality.dual_coordinate_descent(rows, np.ones(3), y, 1.0, 50)
    assert w[0] + w[2] >= 0.99 and w[1] + w[2] <= -0.99
