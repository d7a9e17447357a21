from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from caselens.llm import quality_rules as q
from caselens.llm.textcore import NOT_SPACE, chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t", "one", "a b c a b c a b c", "é*# $%\n\né*# $%\nx", "same line\nsame line\n same line\n\n", "w " * 5000,
    " ".join(f"w{k % 97}" for k in range(300)), "a\x0bb\x0cc a b", "x" * 30_000 + " y", "a b c d a b c", "line\r\nline\r\nline",
]


def brute(text: str | None) -> list[int]:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_base_counts(limit):
    got = [row for c in chunks(pa.array(TEXTS), limit) for row in q.base_counts(c, c.words(NOT_SPACE)).tolist()]
    assert got == [brute(t) for t in TEXTS]


def plain_model(texts: list[str]):
    """log2 probability by the plain recursion over words, each distinct text counted once; and what it is made of."""
    counts, follow = defaultdict(Counter), defaultdict(set)
    for text in set(texts):
        words = ["<s>", *(w.lower() for w in WORD.findall(text))]
        for a, b in zip(words, words[1:], strict=False):
            counts[a][b] += 1
            follow[b].add(a)

    def three(values: list[int]) -> list[float]:
        n = Counter(values)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        ratio = lambda k: n[k + 1] / n[k] if n[k] and n[k + 1] and n[1] else None
        own = [0.0] + [k - (k + 1) * y * ratio(k) if ratio(k) is not None else k / 2 for k in (1, 2, 3)]
        return [min(max(x, 0.05 if k else 0), (0, 0.95, 1.9, 2.85)[k]) for k, x in enumerate(own)]

    high, low = three([c for x in counts.values() for c in x.values()]), three([len(f) for f in follow.values()])
    types = sum(len(x) for x in counts.values())
    left = sum(low[min(len(f), 3)] for f in follow.values()) / types

    def lower(word: str) -> float:
        n = len(follow.get(word, ()))
        return (n - low[min(n, 3)]) / types + left / (len(follow) + 1)

    def probability(context: str, word: str) -> float:
        own = counts[context]
        total = sum(own.values())
        back = sum(high[min(c, 3)] for c in own.values()) / total
        return (own[word] - high[min(own[word], 3)]) / total + back * lower(word) if word in own else back * lower(word)

    return probability, counts, follow


def plain_ppl(rows: list[tuple]) -> list[tuple]:
    out = []
    for lang in {x for _, x, _ in rows}:
        probability, *_ = plain_model([t for _, x, t in rows if x == lang])
        for doc, x, text in rows:
            words = ["<s>", *(w.lower() for w in WORD.findall(text))]
            if x == lang and len(words) > 1:
                out.append((doc, -sum(math.log2(probability(a, b)) for a, b in zip(words, words[1:], strict=False)) / (len(words) - 1)))
    return sorted(out)


def test_plain_model_is_a_distribution():
    rng = np.random.default_rng(5)
    probability, counts, follow = plain_model([" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 60) % 40) for _ in range(60)])
    for context in counts:
        assert math.isclose(sum(probability(context, w) for w in [*follow, "never seen"]), 1, rel_tol=1e-9)


def test_scores_match_the_plain_model(spark):
    rng = np.random.default_rng(8)
    rows = [(k % 50, ["en", "fr", None][k % 3], " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 70) % 500)) for k in range(90)]
    rows += [(200 + k, "en", rows[0][2]) for k in range(20)] + [(300, "fr", rows[0][2]), (301, None, "One")]
    df = spark.createDataFrame([*rows, (None, "en", None)], "doc_id long, lang string, text string")
    got = sorted((r.doc_id, r.log2_ppl) for r in q.assess(df).collect() if r.n_words)
    want = plain_ppl(rows)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], atol=1e-3)


def test_copies_do_not_lower_the_perplexity(spark):
    rng = np.random.default_rng(9)
    rows = [(k, "en", " ".join(f"w{x}" for x in rng.integers(0, 900, 100))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    alone = {r.doc_id: r.log2_ppl for r in q.assess(df).collect()}
    many = q.assess(spark.createDataFrame([*rows, *((k + c * 100, "en", rows[k][2]) for c in range(1, 30) for k in range(5))], df.schema))
    assert all(r.kept and r.log2_ppl == alone[r.doc_id % 100] for r in many.collect())


def test_bigrams_whose_second_words_begin_alike():
    rng = np.random.default_rng(4)
    first = rng.integers(0, 3, 4000).astype(np.uint64) << np.uint64(20)
    second = rng.integers(0, 3, 4000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 4, 4000).astype(np.uint64)
    order, start = q._ordered(first, second)
    pairs = list(zip(first[order].tolist(), second[order].tolist(), strict=True))
    assert pairs == sorted(pairs) and [pairs[k] for k in start] == sorted(set(pairs))


def test_packed_numbers():
    for values in ([], [0], [5, 0, 1 << 40], list(range(1000)), [(1 << 64) - 1, 3]):
        values = np.array(values, np.uint64)
        assert (q._unpacked(q._packed(values)) == values).all()


def test_assess_and_keep(spark):
    rng = np.random.default_rng(1)
    good = [(k, "en", " ".join(f"w{x}" for x in rng.integers(0, 300, 120)), "s", k) for k in range(30)]
    rows = [*good, (100, "en", None, "s", 0), (101, None, "", "s", 0), (102, "en", "w1 w2", "s", 0), (103, "en", "a b c " * 60, "s", 0), good[0], (None, "en", good[1][2], "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, kept string, low long")
    got = q.assess(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.base_failed} == {100, 101, 102, 103}
    assert all(not r.kept for r in got if r.base_failed) and all(r.kept for r in got if not r.base_failed)
    kept = q.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 32
    assert q.assess(df.drop("lang")).where("kept").count() == 32
    assert q.assess(df.limit(0)).count() == 0 and q.keep_good(df.limit(0)).count() == 0


def test_batches_and_shards_give_equal_scores(spark):
    rows = [(k, "en", " ".join(f"w{(k * j) % 53}" for j in range(90))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    one = {r.doc_id: r.log2_ppl for r in q.assess(df.coalesce(1)).collect()}
    assert one == {r.doc_id: r.log2_ppl for r in q.assess(df.repartition(7)).collect()}


def test_scores_use_every_bigram_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(q, "BATCH_WORDS", 3000)
    rng = np.random.default_rng(3)
    rows = [(k, "en", " ".join(map(str, rng.integers(0, 3_000, 1_000)))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = sorted((r.doc_id, r.log2_ppl) for r in q.assess(df).collect())
    assert np.allclose([x for _, x in got], [x for _, x in plain_ppl(rows)], atol=1e-3)


def test_both_bands_reject(spark):
    rng = np.random.default_rng(2)
    follow = rng.integers(0, 400, (400, 30))

    def walk() -> str:
        at = [int(rng.integers(400))]
        for _ in range(119):
            at.append(int(follow[at[-1], rng.integers(30)]))
        return " ".join(f"w{x}" for x in at)

    threes = set()
    formula = ["a", "a"]
    while len(formula) < 66:  # every three of four words once: no repeats for the base rule
        formula.append(next(x for x in "dcba" if (*formula[-2:], x) not in threes))
        threes.add(tuple(formula[-3:]))
    texts = [*(walk() for _ in range(600)), " ".join(formula), " ".join(f"w{x}" for x in rng.integers(0, 400, 120))]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "'en' AS lang", "text")
    got = q.assess(df)
    assert not got.where("base_failed").count()
    out = {r.doc_id: (r.log2_ppl < r.low, r.log2_ppl > r.high) for r in got.where("NOT kept").collect()}
    assert out == {600: (True, False), 601: (False, True)}
    copies = q.assess(spark.createDataFrame([(k, "en", t) for k, t in rows] + [(600 + c * 1000, "en", texts[600]) for c in range(1, 41)], "doc_id long, lang string, text string"))
    assert not copies.where("doc_id % 1000 = 600 AND kept").count()


def test_languages_with_a_common_prefix_are_kept_apart():
    chunk = next(chunks(pa.array(["a b c"])))
    keys = [np.concatenate(q.bigrams(chunk, [lang])[:2]) for lang in ("zh-Hans-CN", "zh-Hans-TW", "?", None)]
    assert len(set(np.concatenate(keys).tolist())) == 16


def test_lines_of_equal_polynomials_are_not_equal():
    """Such pairs have the same polynomial modulo a power of two, whatever the base."""
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    chunk = next(chunks(pa.array([f"{word}\n{other}\n{word}"])))
    assert q.base_counts(chunk, chunk.words(NOT_SPACE))[0].tolist()[3] == 1
