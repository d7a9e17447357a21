from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from caselens.llm import token_binary as t
from caselens.llm.textcore import chunks

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [
    "", " ", "  a", "a  b", "a \n b", "x  y", "x　 y", "é à  ç", "<|endoftext|> a <|endoftext|>", "a<|endoftext|> b c", "don't I'll we 've", "tab\t x", "\n\n a\n\n",
    "日本 語", "a\u0085 b", "x\x7f y", " 's 't it's", "don't. I'll, é's ×'s a×! ÷? é! a're(b)", "x&y %% a$$$ b", "1st 2nd, 3.14", "😀 emoji 👍🏽!", "word " * 4000, "z" * 20_000, "a\r\nb  c",
]


@pytest.mark.parametrize("n", [0, 1, 5, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [1, 2, 40, 1000, 60_000, 1 << 33, (1 << 64) - 1])
def test_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64) if top > 1 else np.zeros(n, np.uint64)
    if n > 300:
        ids[100:300] = 0
    words, sizes = t.pack(ids)
    assert (t.unpack(words, sizes, n) == ids).all() and sizes.sum() == len(words)
    if top < 1 << 60 and n:
        assert len(words) <= n


def test_ids_are_the_librarys():
    encoder = t.PieceEncoder(FILE)
    for chunk in [*chunks(pa.array(TEXTS), 50), *chunks(pa.array(TEXTS[::-1]))]:
        ids, lengths = encoder.encode(chunk.data, chunk.off)
        at = 0
        for k, n in enumerate(lengths.tolist()):
            text = chunk.data[chunk.off[k] : chunk.off[k + 1]].tobytes().decode()
            assert ids[at : at + n].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text[:60]
            at += n


def test_shards(spark, tmp_path):
    rows = [(k * 3, x) for k, x in enumerate(TEXTS)] + [(None, "null id"), (3, "same id"), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 start").repartition(6)
    folder = f"file://{tmp_path}/shards"
    manifest = t.write_token_shards(docs, folder, FILE, partitions=4)
    got = sorted(t.read_token_shards(spark, folder, manifest).collect(), key=lambda r: r.start)
    encoder = t.PieceEncoder(FILE)
    start = 0
    for r, (doc, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    reader = t.ShardReader(f"{folder}/{manifest[0]['name']}")
    assert reader.document(0).tolist()[-1] == 0 and sum(len(ids) for _, _, ids in reader.slices(100)) == reader.n_ids
    assert not list(tmp_path.glob("shards/*.part"))
    empty = t.write_token_shards(docs.limit(0), f"file://{tmp_path}/none", FILE)
    assert empty == [] and t.read_token_shards(spark, folder, empty).count() == 0


def test_damaged_shard(tmp_path):
    (tmp_path / "x.s8b").write_bytes(b"x" * 200)
    with pytest.raises(ValueError):
        t.ShardReader(f"file://{tmp_path}/x.s8b")


def test_generations_of_the_piece_cache(monkeypatch):
    monkeypatch.setattr(t, "CACHE_PIECES", 40)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 500) for _ in range(80)]
    encoder = t.PieceEncoder(FILE)
    most = 0
    for chunk in chunks(pa.array(texts), 300):
        ids, lengths = encoder.encode(chunk.data, chunk.off)
        want = [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts[chunk.first : chunk.first + len(chunk)]]
        assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == list(map(len, want))
        most = max(most, len(encoder.known))
    assert encoder.old and most < 200
