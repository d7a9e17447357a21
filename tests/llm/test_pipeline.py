"""The pipeline's stages on planted documents."""

from __future__ import annotations

import random

import pytest

from caselens.llm import piece_codec, textcore

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = prose(30)
    # texts of different vocabularies: over texts all alike the bands are so narrow that even one near copy makes a text too likely
    varied = lambda n, k: " ".join(f"w{rng.randrange(20 * 2 ** (k % 8))}" for _ in range(n))
    clean = [(k, varied(150, k), "en", f"s{k % 3}", 0) for k in range(40)]
    rows = [*clean, (100, clean[0][1], "en", "s", 0), (101, clean[1][1] + " tail", "en", "s", 0), (102, "too short", "en", "s", 0), (103, None, None, None, None), (104, "a b c " * 100, "en", "s", 0)]
    rows += [(105, f"{prose(60)} {item} {prose(60)}", "en", "s", 0), (106, f"{prose(80)} password=abcdefghijkl0123 {prose(40)}", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' _copy")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if name != "piece_encoding":
            assert out.columns == docs.columns
        at = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
    assert ids(seen["quality_rules"]) == [*range(40), 100, 101, 105, 106]
    assert ids(seen["jaccard_join"]) == [*range(40), 105, 106]
    text = {r.doc_id: r for r in seen["secret_scan"].collect()}
    assert item not in text[105].text and "password" not in text[106].text and "[SECRET]" in text[106].text
    assert all(text[k].text == clean[k][1] for k in range(40)) and all(r.n_chars == len(r.text) for r in text.values())
    done = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(done) == ids(seen["secret_scan"]) and all(r.n_pieces == len(r.ids) > 100 for r in done.values())


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_worker_gives_up_what_another_operator_kept():
    first, second = textcore.worker_cache("test_first"), textcore.worker_cache("test_second")
    try:
        first[0] = second[0] = "kept"
        assert list(textcore.released(iter, "test_first")([1, 2])) == [1, 2]
        assert (first, second) == ({0: "kept"}, {})
        assert list(textcore.released(iter)([])) == [] and first == {}
    finally:
        textcore._caches.pop("test_first"), textcore._caches.pop("test_second")


def test_an_encoder_goes_once_another_stage_uses_the_worker():
    encoder = piece_codec.word_encoder(piece_codec.model_file(), 0)
    assert list(textcore.released(iter, "piece_codec")([])) == [] and encoder in piece_codec._encoders.values()
    assert list(textcore.released(iter)([])) == [] and not piece_codec._encoders
