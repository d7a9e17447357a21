from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from caselens.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    phrases: dict[tuple, set[str]] = {}
    for name, text in items:
        words = low(text)
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if size and name is not None else 0):
            phrases.setdefault(tuple(words[k : k + size]), set()).add(str(name))
    out = []
    for doc, text in docs:
        words, hit, names = low(text), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(words) - size + 1):
                if (found := phrases.get(tuple(words[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    names |= found
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(seed: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    prose = lambda n, v: " ".join(rng.choice(["w", "É", "é", "W"]) + str(rng.randrange(v)) for _ in range(n))
    items: list[tuple] = [(k, prose(rng.randrange(1, 30), 12)) for k in range(12)] + [(12, None), (13, ""), (14, "W1 w2"), (15, "w1, w2!"), (None, "w3 w4"), (3, prose(15, 12))]
    docs: list[tuple] = [(0, None), (1, ""), (2, "..."), (3, "w1 w2 w1 w2")]
    for k in range(60):
        text = prose(rng.randrange(80), rng.choice([6, 12, 400]))
        for _ in range(rng.randrange(3)):
            words = low(rng.choice(items)[1])
            a = rng.randrange(len(words) + 1)
            text += " - " + " ".join(words[a : a + rng.randrange(25)]) + "\n" + prose(5, 400)
        docs.append((10 + k, text))
    return docs + [docs[7], (None, docs[8][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_windows(spark, tmp_path, seed, monkeypatch):
    docs, items = tables(seed)
    if seed == 2:
        monkeypatch.setattr(d, "BLOCK_WORDS", 20)  # several blocks of items
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 items", "2 n_hit").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.op4_decontaminate(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(docs, items)


def test_remove(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"é before. {item.title()}, after", "x"), (2, "clean", "y"), (3, None, "z")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id: (r.text, r.lang) for r in d.remove(docs, bench).collect()} == {1: ("é before. , after", "x"), 2: ("clean", "y"), 3: (None, "z")}
    span = d.find(docs, bench).where("doc_id = 1").first().spans[0]
    assert (span.start, span.end) == (10, 10 + len(item))
    assert d.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0 and d.find(docs.limit(0), bench).count() == 0
    assert d.remove(docs, bench).schema == docs.schema


def test_index_against_a_scan():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (40, 2), (300, 3), (500, 40)):
        symbols = rng.integers(0, top + 1, n)
        symbols[-1] = 0
        order = d.suffix_array(symbols)
        zeros = np.cumsum(symbols == 0)
        key = lambda k: [(0, int(zeros[i])) if symbols[i] == 0 else (1, int(symbols[i])) for i in range(k, n)]  # noqa: B023, E731
        assert order.tolist() == sorted(range(n), key=key)
        index = d.FMIndex(symbols, top)
        for size in (1, 2, 4):
            grid = rng.integers(1, top + 1, (20, size))
            a, b = index.search(grid, np.full(20, size))
            for row, x, y in zip(grid, a, b, strict=True):
                want = [k for k in range(n - size + 1) if (symbols[k : k + size] == row).all()]
                assert sorted(index.locate(np.arange(x, max(x, y))).tolist()) == want
