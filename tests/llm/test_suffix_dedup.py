from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from caselens.llm import suffix_dedup as s


def brute(texts: list[str | None], length: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[k : k + length] for x in raw for k in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for k in range(len(x) - length + 1):
            if count[x[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        out.append((len(x), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed: int, length: int) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(length // 3) for _ in range(4)]
    out: list[str | None] = [None, "", "x" * (length - 1), "x" * length, "y" * (length + 1), "z" * (3 * length), "ab" * length, "abcdefg" * length]
    for _ in range(25):
        parts = [prose(rng.randrange(length // 2)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            parts.insert(rng.randrange(len(parts)), p[a : a + rng.randrange(len(p) - a)])
        out.append(rng.choice(["", " "]).join(parts))
    out += [out[12], out[12], out[13] + "!", out[14][5:], out[15][:-5]]
    return out


@pytest.mark.parametrize(("seed", "length"), [(1, 400), (2, 70), (3, 30), (4, 5)])
def test_against_all_strings(spark, seed, length):
    rows = list(enumerate(texts(seed, length)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 start", "'a' print").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.remaining(df, length).collect()}
    want = brute([t for _, t in rows], length)
    assert [got[k] for k, _ in rows] == want
    assert any(n for _, n, _, _ in want)


def test_equal_and_null_ids(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(900))
    other = long[:450] + "".join(rng.choice("ijkl ") for _ in range(200))
    rows = [(1, long), (1, long), (None, other), (None, None), (2, "short"), (1, other[::-1])]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in s.remaining(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 900, 900, 1), (1, 900, 900, 1), (None, 650, 450, 1), (None, 0, 0, 0), (2, 5, 0, 0), (1, 650, 0, 0)], key=str)
    assert s.remaining(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sorting_finds_equal_suffixes():
    rng = np.random.default_rng(0)
    for length in (4, 8, 12, 30):
        buffer = rng.integers(97, 99, 500, dtype=np.uint8)
        at = np.arange(len(buffer) - length + 1)
        group = rng.integers(0, 3, len(at))
        count = Counter((g, buffer[a : a + length].tobytes()) for a, g in zip(at, group, strict=True))
        want = [count[g, buffer[a : a + length].tobytes()] > 1 for a, g in zip(at, group, strict=True)]
        assert s.repeated_suffixes(buffer, at, group, length).tolist() == want


def brute_words(texts: list[str | None], n: int) -> list[int]:
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for w in words:
        hit = set()
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                hit.update(range(k, k + n))
        out.append(len(hit))
    return out


@pytest.mark.parametrize(("seed", "n"), [(1, 50), (2, 12), (3, 8)])
def test_passages_against_all_strings_of_words(spark, seed, n):
    rows = list(enumerate([*texts(seed, 8 * n), " ".join(["w"] * (3 * n)), " ".join(f"a{k}" for k in range(n)), "\n".join(f"a{k}" for k in range(n)), " ".join(f"a{k}" for k in range(n - 1))]))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 n_words").repartition(5)
    got = {r.doc_id: r.n_words for r in s.passages(df, n).collect()}
    want = brute_words([t for _, t in rows], n)
    assert [got.get(k, 0) for k, _ in rows] == want and any(want)


def test_query_names_passages_of_few_bytes(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage = prose(55)
    rows = [(k, f"{prose(40)} {passage if k < 3 else prose(55)} {prose(40)}") for k in range(8)] + [(None, None), (8, ""), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 n_words", "2 print").write.parquet(f"{tmp_path}/documents.parquet")
    got = s.op9_suffix_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sorted(r.doc_id for r in got if r.n_passage_words) == [0, 1, 2]
    assert {r.n_passage_words for r in got} == {0, 55} and not any(r.n_removed for r in got)
