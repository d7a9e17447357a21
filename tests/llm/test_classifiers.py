from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from caselens.llm import quality_qda, toxicity
from caselens.llm.textcore import chunks

LOWER = {c: c + 32 for c in range(65, 91)}
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def tables(spark, path, n=500):
    docs, labels = [], []
    for k in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        text = prose(rng.randrange(30, 120))
        if not good:
            text = rng.choice([text.upper() + "!!", " ### ".join(text.split()), (prose(4) + " ") * 20])
        if toxic:
            at = rng.randrange(len(text))
            text = f"{text[:at]} horridword {text[at:]}"
        docs.append((k, text, "en"))
        labels.append((k, int(good), int(toxic)))
    docs += [(n, None, "en"), (n + 1, "", None), (n + 2, "x" * 20_000, "en"), (None, "no id", "en"), docs[0]]
    labels += [(n, None, None), (None, 1, 1), (0, labels[0][1], labels[0][2]), (n + 9, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 score", "2 label").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, {k: (q, t) for k, q, t in labels if k is not None and k < n}


@pytest.mark.parametrize(("query", "column", "folds", "fold"), [(quality_qda.op5_quality_classifier, 0, 3, 1), (toxicity.op6_toxicity, 1, 5, 0)])
def test_held_out_accuracy(spark, tmp_path, query, column, folds, fold):
    docs, labels = tables(spark, tmp_path)
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % folds == fold for r in held)
    right = [r.predicted == labels[r.doc_id][column] for r in held if r.doc_id in labels]
    assert np.mean(right) > 0.95
    same = [r.score for r in got if r.doc_id == 0]
    assert len(same) == 2 and same[0] == same[1]


def test_without_labels_or_rows(spark, tmp_path):
    docs, _ = tables(spark, tmp_path, 20)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, label int")
    weights = toxicity.fit(df, none)
    assert {r.score for r in toxicity.score(df, weights).collect()} == {0.5}
    x = quality_qda.features(df)
    model = quality_qda.fit(x.join(none, "doc_id").select("x", "label"))
    assert {r.score for r in quality_qda.score(x, model).collect()} == {0.5}
    assert toxicity.score(df.limit(0), weights).count() == 0 and quality_qda.features(df.limit(0)).count() == 0


def test_discriminant_is_the_difference_of_normal_densities(spark):
    d = len(quality_qda.FEATURES)
    g = np.random.default_rng(0)
    x = np.concatenate([g.normal(0, 1, (400, d)), g.normal(0.5, 2, (600, d))])
    label = [0] * 400 + [1] * 600
    df = spark.createDataFrame([(row.tolist(), y) for row, y in zip(x, label, strict=True)], "x array<double>, label int")
    model = quality_qda.fit(df)
    groups = [x[:400], x[400:]]
    covariances = [np.cov(a.T, bias=True) for a in groups]
    pooled = (400 * covariances[0] + 600 * covariances[1]) / 1000
    p, s = quality_qda.SHRINK_POOLED, quality_qda.SHRINK_SPHERE
    want = np.log(601 / 401)
    probe = x[::50]
    for sign, a, c in zip((-1, 1), groups, covariances, strict=True):
        c = (1 - p - s) * c + p * pooled + s * np.diag(np.diag(pooled))
        z = probe - a.mean(axis=0)
        want = want + sign * (-0.5 * np.einsum("ij,ij->i", z @ np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.log_odds(probe), want)


def test_features_are_words_pairs_and_skips():
    chunk = next(chunks(pa.array(["a b c", "A, b!", ""])))
    of, at = toxicity.hashed(chunk)
    assert np.bincount(of, minlength=3).tolist() == [6, 3, 0]  # words, pairs, skip pairs
    assert set(at[of == 1]) < set(at[of == 0])


def test_strong_l1_keeps_few_weights():
    g = np.random.default_rng(1)
    examples = []
    for k in range(600):
        label = k % 3 == 0
        at = g.integers(100, 1 << 16, 60)
        examples.append((np.unique(np.append(at, 7) if label else at).astype(np.int32), int(label)))
    w = toxicity.learn(examples)
    assert 7 in w.at and len(w.at) < 2000 and w.weight[w.at.tolist().index(7)] > 2


def test_weights_are_those_of_plain_ftrl():
    """The published per-coordinate rule, written out over a dictionary."""
    g = np.random.default_rng(3)
    examples = [(np.unique(g.integers(0, 300, 12)).astype(np.int32), int(g.random() < 0.4)) for _ in range(300)]
    z, n, bias = {}, {}, 1 << toxicity.BITS

    def weight(i: int) -> float:
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for at, label in examples:
            own = [*at.tolist(), bias]
            w = {i: weight(i) for i in own}
            gradient = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in own:
                before = n.get(i, 0.0)
                n[i] = before + gradient**2
                z[i] = z.get(i, 0.0) + gradient - (n[i] ** 0.5 - before**0.5) / toxicity.ALPHA * w[i]
    got = toxicity.learn(examples)
    want = {i: weight(i) for i in sorted(z) if i != bias and weight(i)}
    assert got.at.tolist() == list(want) and np.allclose(got.weight, list(want.values()), atol=1e-5) and abs(got.bias - weight(bias)) < 1e-9


def test_toxicity_of_string_ids_and_repeated_ids(spark):
    docs = [(f"d{k % 60}", f"{'horridword' if k % 60 % 2 else 'kind'} {prose(20)}") for k in range(180)] + [(None, None)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(60)], "doc_id string, label int")
    weights = [toxicity.fit(x, labels) for x in (df, df.repartition(7))]
    assert weights[0].at.tolist() == weights[1].at.tolist() and weights[0].weight.tolist() == weights[1].weight.tolist()
    got = toxicity.score(df, weights[0]).collect()
    assert len(got) == len(docs) and all((r.score >= 0.5) == (int(r.doc_id[1:]) % 2 == 1) for r in got if r.doc_id)


def test_one_class_of_labels(spark, tmp_path):
    tables(spark, tmp_path, 30)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = spark.range(10).selectExpr("id doc_id", "1 label")
    x = quality_qda.features(df)
    model = quality_qda.fit(x.join(one, "doc_id").select("x", "label"))
    assert len({r.score for r in quality_qda.score(x, model).collect()}) == 1 and model.factors is None
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, toxicity.fit(df, one)).collect())
    for query in (quality_qda.op5_quality_classifier, toxicity.op6_toxicity):
        empty = tmp_path / query.__name__
        df.limit(0).write.parquet(f"{empty}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
        assert query(spark, str(empty)).count() == 0


def test_statistics_against_plain_counts():
    """Every feature from its definition, over the text itself."""
    symbols, stops, plain_end = "#*$%&|<>@^~=+_/\\{}[]", ".,;:!?", ".,;:?)'\""

    def plain(text: str) -> list[float]:
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        low = [w.lower() for w in words]
        data = text.encode()
        n, chars = len(words), sum(map(len, words))
        logit = lambda part, whole: np.log((part + 0.5) / (max(whole - part, 0) + 0.5))
        count = lambda f: logit(sum(map(f, data)), chars)
        lines = [x for x in text.split("\n") if x] if n else []
        mean, m = (chars / n if n else 0), max(1, len(lines))
        spread = np.sqrt(sum((len(w) - mean) ** 2 for w in words) / max(n, 1))
        odd = sum(not (chr(w[-1]).isalnum() and w[-1] < 128 or w[-1] > 127 or chr(w[-1]) in plain_end) for w in words)
        return [
            np.log1p(n), mean, np.log1p(spread), count(lambda c: chr(c) in symbols), count(lambda c: 65 <= c <= 90), count(lambda c: 48 <= c <= 57),
            count(lambda c: chr(c) in stops), count(lambda c: c > 127), np.log(max(n, 1) / max(len(set(low)), 1)), np.log(max(n - 1, 1) / max(len(set(itertools.pairwise(low))), 1)),
            np.log(m / max(1, len({x.translate(LOWER) for x in lines}))), np.log1p(len(data) / m), logit(max((low.count(w) for w in low), default=1) - 1, max(n, 1)), logit(odd, n),
        ]

    texts = [None, "", " \n ", "word", "Ünï Çö 12,5% a a A!", "one line\n\none line\nOne Line\nx", prose(200), f"{prose(30)}\n{prose(30)} @@ #1 {prose(4)}\n"]
    got = np.concatenate([quality_qda.statistics(c) for c in chunks(pa.array(texts), 64)])
    assert np.allclose(got, [plain(t or "") for t in texts])
