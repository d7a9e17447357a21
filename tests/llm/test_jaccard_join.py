from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from caselens.llm import jaccard_join as j
from caselens.llm.components import components
from caselens.llm.textcore import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text: str | None, n: int) -> frozenset:
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def brute(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    sets = [grams(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def root(x: int) -> int:
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(k)] = min(doc, least.get(root(k), doc))
    return sorted(((doc, len(sets[k]), least.get(root(k))) for k, (doc, _) in enumerate(rows)), key=str)


def near_copies(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows: list[tuple] = [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two"), (906, "ONE  two"), (907, "é É"), (None, "null id text of some words here")]
    for k in range(40):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([2, 4, 8, 12, 20, 30, 60, 150, 400]))]
        rows.append((k * 20, " ".join(base)))
        for c in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 20 + 2)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["new"], [copy[at], f"x{rng.randrange(9)}"]])
            rows.append((k * 20 + c + 1, " ".join(copy)))
            base = copy if rng.random() < 0.5 else base
    rows.append(rows[-1])
    return rows


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 90, 3)])
def test_against_all_pairs(spark, n, percent, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' component_id", "1 node")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(df, n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_NODES", 4)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(100)]
    rows = [(0, " ".join(base))] + [(k, " ".join("n" if i == k else w for i, w in enumerate(base))) for k in range(1, 60)]
    base = [f"v{rng.randrange(1000)}" for _ in range(100)]
    for k in range(60, 90):  # a chain that drifts away
        base = list(base)
        base[(k * 3) % 100] = f"u{k}"
        rows.append((k, " ".join(base)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=str)
    assert got == brute(rows, 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for size in [1, 2, 5, 8, 9, 10, 12, 18, 19, 28, 40, 60, 100, 300]:
        for _ in range(15):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = a.copy()
            most = len(a) * 2 * (100 - percent) // (100 + percent)
            b = b[rng.permutation(len(b))[: len(b) - most // 2]]
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, most - most // 2, dtype=np.uint64)]))
            if j.linked(a, b, percent):
                sig, owner = j.signatures([a, b], percent)
                assert set(sig[owner == 0]) & set(sig[owner == 1])


def test_empty_table_and_keep_one(spark):
    df = spark.createDataFrame([(2, "a b c d e f g h", "x"), (1, "A b c d e f g h", "y"), (3, None, "z"), (4, None, "z"), (5, "other words", None)], "doc_id long, text string, _copy string")
    assert {r.doc_id for r in j.keep_one(df).collect()} == {1, 3, 4, 5}
    assert j.keep_one(df).columns == df.columns


def test_keep_one_goes_by_rows(spark):
    """Repeated rows of the least id, null ids and an id with two texts."""
    text, other = "a b c d e f g h", "some quite other words than those"
    rows = [(1, text, 1), (1, text, 2), (2, text, 3), (None, text, 4), (None, other, 5), (None, other, 6), (3, text, 7), (3, "words of an id with two texts", 8), (4, None, 9), (4, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    kept = j.keep_one(df).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, other), (1, text), (3, rows[7][1]), (4, ""), (4, "")]
    assert j.keep_one(df).columns == df.columns


def test_blocks_of_a_frequent_signature(spark, monkeypatch):
    monkeypatch.setattr(j, "GROUP_NODES", 6)
    rows = near_copies(2) + [(2000 + k, " ".join(["one", "very", "common", "passage", "of", "ten", "words", "stands", "here", "too", f"x{k % 40}", f"y{k}"])) for k in range(80)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, _copy string")
    assert j.keep_one(df).count() == 0
    assert j.join(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)]
    group = {x: x for e in links for x in e}

    def root(x: int) -> int:
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        group[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: root(x) for x in group if any(x in e and e[0] != e[1] for e in links)}
    assert got == want


def test_shingles_of_short_texts():
    sets = [s for c in chunks(pa.array(["a b", "a  B", "a", None, "a b c", "a b c d"]), 3) for s in j.shingles(c, 3)]
    assert [len(s) for s in sets] == [1, 1, 1, 0, 1, 2] and sets[0][0] == sets[1][0] and sets[4][0] in sets[5]


def test_large_groups_with_pivots(spark, monkeypatch):
    """Near copies of one text, a drifting chain, and texts that only share a passage: in groups above the block size."""
    monkeypatch.setattr(j, "BLOCK_NODES", 8)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(100_000)}"
    base = [word() for _ in range(120)]
    rows = []
    for k in range(70):  # all linked with each other
        copy = list(base)
        copy[rng.randrange(120)] = word()
        rows.append((k, " ".join(copy)))
    chain = [word() for _ in range(90)]
    for k in range(40):  # linked with the next ones only, and growing
        chain = [*chain, word(), word()]
        chain[(k * 7) % 80] = word()
        rows.append((100 + k, " ".join(chain)))
    passage = " ".join(word() for _ in range(40))
    rows += [(200 + k, f"{passage} {' '.join(word() for _ in range(8 + k % 9))}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80)):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(df, n, percent).collect()), key=str)
        assert got == brute(rows, n, percent)


def test_groups_are_those_of_signatures_that_several_nodes_share():
    rng = np.random.default_rng(5)
    sig, node = rng.integers(0, 3_000, 4_000, dtype=np.uint64) << np.uint64(50), rng.integers(1, 100, 4_000)  # 0 would add nothing to a name
    want = {frozenset(node[sig == s].tolist()) for s in np.unique(sig)}
    rows = []
    for part in np.array_split(np.lexsort((node, sig)), 7):
        names, index = np.unique(node[part], return_inverse=True)
        rows.append([0, j._planes(np.diff(sig[part], prepend=np.uint64(0))), j._planes(index.astype(np.uint32)), names.tobytes()])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["shard", "signatures", "index", "nodes"])
    got = [frozenset(x) for b in j._group_task([batch]) for x in b.column("nodes").to_pylist()]
    assert len(got) == len(set(got)) and set(got) == {x for x in want if len(x) > 1}
    alone = batch.slice(0, 1).set_column(1, "signatures", pa.array([j._planes(np.arange(1, len(sig[:572]) + 1).astype(np.uint64))]))
    assert list(j._group_task([alone])) == []


def test_a_shards_pairs_are_let_go_before_they_are_ordered():
    sig, node = [np.array([7, 1, 7], np.uint64), np.array([3, 9], np.uint64)], [np.array([5, 4, 6]), np.array([8, 2])]
    found, nodes = j._met(sig, node)
    assert (found.tolist(), sorted(nodes.tolist()), sig, node) == ([7, 7], [5, 6], [], [])
