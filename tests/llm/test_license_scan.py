from __future__ import annotations

import itertools
import random
import re

from caselens.llm import license_scan as s


def test_longest_increasing():
    rng = random.Random(1)
    for _ in range(200):
        values = [rng.randrange(8) for _ in range(rng.randrange(8))]
        got = s.longest_increasing(values)
        assert all(a < b and values[a] < values[b] for a, b in itertools.pairwise(got))
        best = max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if all(a < b for a, b in itertools.pairwise(c))), default=0)
        assert len(got) == best


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(20))]
        b = [x for x in a if rng.random() < 0.8]
        b.insert(rng.randrange(len(b) + 1), 99)
        pairs = s.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    assert s.align(a, a) == [(k, k) for k in range(len(a))]


def plain(text: str, name: str) -> bool:
    """Every stretch of the text, aligned with the template without any filter."""
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    want = re.findall(r"[a-z0-9]+", s.TEMPLATES[name].lower())
    m = len(want)
    return any(len(s.align(want, words[k : k + 2 * m])) >= s.MIN_COVERAGE * m for k in range(0, len(words), m))


def test_found_where_planted(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["the", "and", "of", "é", "software", "word", "license", "use"]) for _ in range(n))
    rows, planted = [], {}
    for k, (name, text) in enumerate(s.TEMPLATES.items()):
        words = text.split()
        for _ in range(len(words) // 15):  # some words go or change
            words[rng.randrange(len(words))] = rng.choice(["", "changed"])
        copy = " ".join(words) if len(words) > 20 else text.upper()
        rows.append((k, f"{prose(rng.randrange(300))}\n* {copy}\n{prose(300)}"))
        planted[k] = name
    rows += [(100, None), (101, ""), (102, prose(3000)), (103, f"{s.TEMPLATES['MIT-notice']}. {prose(40)} {s.TEMPLATES['MIT-notice']}"), (None, "All rights reserved"), (102, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 licenses")
    got = s.scan(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 102}
    text = dict(rows)
    for k, name in planted.items():
        found = {x.name: x for x in by[k].licenses}
        assert name in found, name
        assert all(plain(text[k], n) for n in found)
        assert text[k][: found[name].start].isascii() or found[name].start < len(text[k])
    assert not by[100].licenses and not by[101].licenses
    assert [x.name for x in by[103].licenses].count("MIT-notice") == 2
    first = by[103].licenses[0]
    assert text[103][first.start : first.end] == s.TEMPLATES["MIT-notice"]
    assert [x.name for x in by[None].licenses] == ["All-rights-reserved"]
    assert s.scan(df.limit(0)).count() == 0


def found_in(text: str) -> list[tuple[str, str]]:
    """Name and covered text of all matches, across templates, as ``scan`` settles them."""
    words, _, _ = s._hashed(text)
    places = [m.span() for m in re.finditer(r"[a-z0-9\x80-\U0010ffff]+", text.lower())]
    matches = []
    for t in (s.template(n, x) for n, x in s.TEMPLATES.items()):
        at = [k for k, w in enumerate(words) if w in t.signals]
        matches += [(*m, t.name) for m in s.find(words, at, t, s.MIN_COVERAGE, s.MIN_DENSITY)] if at else []
    return [(name, text[places[a][0] : places[b - 1][1]]) for a, b, _, name in s._apart(matches)]


def test_versions_and_variants_are_told_apart():
    for name, text in s.TEMPLATES.items():
        assert [n for n, _ in found_in(f"some words before {text} and some after")] == [name]
    assert found_in("Licensed under CC BY 4.0") == [("CC-BY-4.0-short", "Licensed under CC BY 4.0")]
    assert [n for n, _ in found_in("licensed under the GNU General Public License, version 2")] == ["GPL-2.0-notice"]
    assert found_in("Licensed under CC BY-NC-ND 4.0") == [] and found_in("licensed under the GNU General Public License, version 1") == []


def test_copies_in_a_row_at_every_offset():
    for name in ("MIT-notice", "All-rights-reserved", "Apache-2.0-notice", "ISC"):
        text = s.TEMPLATES[name].rstrip(".")
        for lead in range(9):
            for copies in (1, 2, 3, 10):
                joined = f"{'word ' * lead}{' '.join([text] * copies)} end"
                assert [n for n, _ in found_in(joined)] == [name] * copies, (name, lead, copies)


def common_length(a: list, b: list) -> int:
    """Length of a longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for k, y in enumerate(b, 1):
            row[k], diagonal = (diagonal + 1 if x == y else max(row[k], row[k - 1])), row[k]
    return row[-1]


def test_against_windows_at_every_word():
    """Every stretch of the allowed lengths, aligned by the plain table: what is found covers enough, and all stretches that surely do are found."""
    rng = random.Random(8)
    for name in ("MIT-notice", "ISC", "CC0-1.0-notice", "BSD-3-Clause-clause"):
        t = s.template(name, s.TEMPLATES[name])
        m = len(t.words)
        for _ in range(12):
            copy = [w for w in t.words if w in t.marks or rng.random() > 0.1]
            for _ in range(rng.randrange(m // 4 + 1)):
                copy.insert(rng.randrange(1, len(copy)), rng.randrange(1 << 60))
            words = [rng.choice([*t.words, 5, 6, 7, 8, 9, 10, 11, 12]) for _ in range(rng.randrange(40))] + [1, 2] + copy + [3] + [rng.choice([*t.words, 1, 2, 3, 4]) for _ in range(rng.randrange(30))]
            found = s.find(words, [k for k, w in enumerate(words) if w in t.signals], t, s.MIN_COVERAGE, s.MIN_DENSITY)
            for a, b, n in found:
                assert n <= common_length(t.words, words[a:b]) and n >= s.MIN_COVERAGE * m and n >= s.MIN_DENSITY * (b - a)
            whole = len([w for w in copy if w in set(t.words)])
            if whole >= s.MIN_COVERAGE * m and whole >= s.MIN_DENSITY * len(copy):
                start = words.index(2) + 1
                assert any(a < start + len(copy) and b > start for a, b, _ in found), name
