"""Suffix-array dedup: removes bytes of passages that occur more than once.

A byte goes if it lies in a string of ``length`` bytes that also starts
anywhere else, in the same document or another one, as judged on the input.

Every string of ``length`` bytes is a suffix start, too many to shuffle with
their text.  So suffixes are routed by a leading token that depends on their
``length`` bytes alone: the least hash of the ``GRAM``-byte strings in them.
Neighbouring starts mostly have the same token, and travel as one run of text.
Tokens that stand in one place only are counted first and left out (by a filter
that may let some through, which only costs work).  Splitters
sampled from the remaining tokens cut them into buckets of about equal size (and
a hash cuts further where there would be more than ``SPLITTERS`` of them);
equal tokens never lie in two buckets, so no two equal strings
do, and buckets need no comparison across their boundaries.  A bucket sorts
its suffixes by token, then by eight bytes twice for those that still tie, then
by a hash of the rest in place of more such keys, and compares neighbours
byte by byte.  Equal runs of a task travel once, so copies cost little.

``passages`` does the same over words: a text is the row of its words' 64-bit
hashes, suffixes start at words, and a string is ``PASSAGE_WORDS`` words (so
eight times as many bytes).  It finds repeated passages of many words whatever
their bytes.

Defined cases: a null text is empty; texts shorter than ``length`` stay as they
are; equal rows are copies of each other; null and equal ids are allowed, as
rows are told apart by id and text; other columns are ignored by ``spans``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import NOT_SPACE, Chunk, bit_filter, chunks, combine, in_filter, mix, released, rolling_prefix, span_hash, written

GRAM = 64
#: bytes of runs that a bucket holds, about, and splitters at most
BUCKET_BYTES, SPLITTERS = 16 << 20, 4096
#: words of a passage, and bytes of a word's hash
PASSAGE_WORDS, WORD = 50, 8
_U = np.uint64


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Bytes:
    """A chunk's suffixes at every byte: hashes of its grams and of spans."""

    unit = 1

    def __init__(self, chunk: Chunk):
        self.data, self.off = chunk.data, chunk.off
        self.prefix = rolling_prefix(self.data)

    def grams(self, gram: int) -> np.ndarray:
        starts = np.arange(len(self.data) - gram + 1)
        return span_hash(self.prefix, starts, starts + gram)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hash(self.prefix, starts, ends, self.data)


class Words:
    """A chunk's suffixes at every word; a word is the eight bytes of its hash."""

    unit = WORD

    def __init__(self, chunk: Chunk):
        starts, ends, at = chunk.words(NOT_SPACE)
        self.words = span_hash(rolling_prefix(chunk.data), starts, ends, chunk.data)
        self.data, self.off = self.words.view(np.uint8), WORD * at
        self._prefix = None

    def grams(self, gram: int) -> np.ndarray:
        n = gram // WORD
        return combine([self.words[k : len(self.words) - n + 1 + k] for k in range(n)])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._prefix is None:
            self._prefix = rolling_prefix(self.data)
        return span_hash(self._prefix, starts, ends, self.data)


def token_places(text: Bytes | Words, length: int) -> np.ndarray:
    """The token at each place where it stands.  Equal suffixes mean that their token stands in two places, be it in one run."""
    unit = text.unit
    n, m, gram = len(text.data) // unit, length // unit, min(GRAM, length) // unit
    if n < m:
        return np.zeros(0, np.uint64)
    hashes = text.grams(gram * unit)
    width = m - gram + 1
    token = _sliding_minimum(hashes, width)
    doc = np.repeat(np.arange(len(text.off) - 1), np.diff(text.off) // unit)
    token[doc[: n - m + 1] != doc[m - 1 :]] = 0
    # a string is a token if it is the least of one of the suffixes that hold it, that is, of the one with the greatest token
    edge = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    greatest = ~_sliding_minimum(np.concatenate([edge, ~token, edge]), width)
    return hashes[greatest == hashes]


def runs(text: Bytes | Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token, first start, last start (in bytes) and document of each run of neighbouring suffixes with one token."""
    unit = text.unit
    n, m, gram = len(text.data) // unit, length // unit, min(GRAM, length) // unit
    none = np.zeros(0, np.int64)
    if n < m:
        return none.astype(_U), none, none, none
    token = _sliding_minimum(text.grams(gram * unit), m - gram + 1)
    doc = np.repeat(np.arange(len(text.off) - 1), np.diff(text.off) // unit)
    inside = np.flatnonzero(doc[: n - m + 1] == doc[m - 1 :])
    if not len(inside):
        return none.astype(_U), none, none, none
    token, owner = token[inside], doc[inside]
    first = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(first[1:], len(inside)) - 1
    return token[first], unit * inside[first], unit * inside[last], owner[first]


def fingerprints(chunk: Chunk) -> np.ndarray:
    """64-bit hash of each document's text, as signed longs."""
    return span_hash(rolling_prefix(chunk.data), chunk.off[:-1], chunk.off[1:], chunk.data).view(np.int64)


# -- buckets --------------------------------------------------------------


def _eight(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes at every offset, big-endian, so that their order is that of the bytes."""
    return np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))


def repeated_suffixes(buffer: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each suffix start, whether another start of its group has the same ``length`` bytes."""
    out = np.zeros(len(at), bool)
    live, part = np.arange(len(at)), group
    eight = _eight(np.concatenate([buffer, np.zeros(8, np.uint8)]))
    depth = 0
    for step in range(3):
        if step < 2 and depth + 8 <= length:
            key = eight[at[live] + depth].astype(_U)
            depth += 8
        elif step == 2 and depth < length:
            prefix = rolling_prefix(buffer)
            key = span_hash(prefix, at[live] + depth, at[live] + length)
        else:
            continue
        order = np.lexsort((key, part))
        live, part, key = live[order], part[order], key[order]
        fresh = np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])))
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        part = np.cumsum(fresh)[tied]
        live = live[tied]
        if not len(live):
            return out
    a, b = at[live[:-1]], at[live[1:]]
    same = np.flatnonzero(part[1:] == part[:-1])
    a, b = a[same], b[same]
    equal = np.ones(len(same), bool)
    for k in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        equal &= eight[a + k] == eight[b + k]
    if length < 8:
        equal = np.array([buffer[x : x + length].tobytes() == buffer[y : y + length].tobytes() for x, y in zip(a, b, strict=True)], bool)
    out[live[:-1][same[equal]]] = True
    out[live[1:][same[equal]]] = True
    return out


def _bucket_spans(keys: np.ndarray, texts: list[bytes], length: int, counts: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removal spans of distinct runs (key, text, number of places): run, start and end."""
    order = np.argsort(keys, kind="stable")
    size = np.array([len(texts[k]) for k in order], np.int64)
    own = keys[order]
    fresh = np.concatenate(([True], own[1:] != own[:-1]))
    group = np.cumsum(fresh) - 1
    runs_of = np.bincount(group)
    # a token whose only run stands in several places needs no sorting
    sort = (runs_of[group] > 1) | (counts[order] == 1)
    buffer = np.frombuffer(b"".join(texts[k] for k in order), np.uint8)
    base = np.cumsum(size) - size
    n = (size - length) // unit + 1
    at = unit * np.arange(n.sum()) + np.repeat(base - unit * (np.cumsum(n) - n), n)
    run = np.repeat(np.arange(len(order)), n)
    hit = np.repeat(counts[order] > 1, n)
    pick = np.flatnonzero(sort[run])
    if len(pick):
        hit[pick] |= repeated_suffixes(buffer, at[pick], group[run[pick]], length)
    hits = np.flatnonzero(hit)
    if not len(hits):
        return hits, hits, hits
    first = np.concatenate(([True], (hits[1:] != hits[:-1] + 1) | (run[hits[1:]] != run[hits[:-1]])))
    begin, end = hits[first], hits[np.append(np.flatnonzero(first)[1:], len(hits)) - 1]
    which = run[begin]
    return order[which], at[begin] - base[which], at[end] - base[which] + length


_RUN = "bucket int, key long, data binary, ids array<{0}>, prints array<long>, starts array<long>"


def _run_task(length: int, kind: type, shared, splitters: np.ndarray, parts: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                text = kind(chunk)
                token, first, last, doc = runs(text, length)
                keep = in_filter(raw, token)
                token, first, last, doc = token[keep], first[keep], last[keep], doc[keep]
                if not len(token):
                    continue
                same = text.spans(first, last + length)
                order = np.lexsort((same, token))
                fresh = np.flatnonzero(np.concatenate(([True], (token[order][1:] != token[order][:-1]) | (same[order][1:] != same[order][:-1]))))
                lead = order[fresh]
                offsets = pa.array(np.append(fresh, len(order)).astype(np.int32))
                own = doc[order]
                ids = pa.ListArray.from_arrays(offsets, batch.column("doc_id").take(pa.array(own + chunk.first)))
                prints = pa.ListArray.from_arrays(offsets, pa.array(fingerprints(chunk)[own]))
                starts = pa.ListArray.from_arrays(offsets, pa.array(first[order] - text.off[own]))
                data = [text.data[a : b + length].tobytes() for a, b in zip(first[lead], last[lead], strict=True)]
                bucket = np.searchsorted(splitters, token[lead].view(np.int64), "right") * parts + (mix(token[lead]) % _U(parts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(token[lead].view(np.int64)), pa.array(data, pa.binary()), ids, prints, starts], ["bucket", "key", "data", "ids", "prints", "starts"])

    return go


def _bucket_task(length: int, unit: int):
    """Rows of whole buckets, bucket after bucket, in any order within."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            number: dict[tuple[int, bytes], int] = {}
            run = np.array([number.setdefault(pair, len(number)) for pair in zip(table.column("key").to_pylist(), table.column("data").to_pylist(), strict=True)], np.int64)
            flat = {name: table.column(name).combine_chunks().flatten() for name in ("ids", "prints", "starts")}
            lengths = np.concatenate([np.diff(x.offsets) for x in table.column("ids").chunks])
            of = np.repeat(run, lengths)
            places = np.argsort(of, kind="stable")
            counts = np.bincount(of, minlength=len(number))
            where = np.cumsum(counts) - counts
            keys = np.fromiter((k for k, _ in number), np.int64, len(number))
            which, begin, end = _bucket_spans(keys, [t for _, t in number], length, counts, unit)
            n = counts[which]
            row = places[np.arange(n.sum()) + np.repeat(where[which] - (np.cumsum(n) - n), n)]
            start = flat["starts"].to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [flat["ids"].take(pa.array(row)), pa.array(flat["prints"].to_numpy()[row]), pa.array(start + np.repeat(begin, n)), pa.array(start + np.repeat(end, n))],
                ["doc_id", "print", "start", "end"],
            )

        for batch in batches:
            edges = batch.column("bucket").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(edges)) + 1).tolist(), len(edges)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if edges[a] != bucket and held:
                    yield from done()
                    held.clear()
                bucket = edges[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return go


def spans(docs: DataFrame, length: int = 400, kind: type = Bytes) -> DataFrame:
    """``doc_id, print, start, end``: spans to remove, overlapping and touching ones included; ``print`` hashes the text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                distinct, counts = np.unique(token_places(kind(chunk), length), return_counts=True)
                if len(distinct):
                    yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "n"])

    counted = docs.select("text").mapInArrow(released(tokens), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = written(spark, counted, "tokens")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (length + 200) // BUCKET_BYTES) + 1)
    ranges = min(buckets, SPLITTERS)
    parts = -(-buckets // ranges)
    quantiles = [k / ranges for k in range(1, ranges)]
    found = repeated.agg(F.percentile_approx("h", F.array(*map(F.lit, quantiles)), F.lit(max(10_000, 4 * ranges))).alias("q")).first().q if quantiles else None
    splitters = np.unique(np.array(found or [], np.int64))
    shared = spark.sparkContext.broadcast(bit_filter(repeated, "h"))
    rows = docs.mapInArrow(released(_run_task(length, kind, shared, splitters, parts)), _RUN.format(id_kind))
    placed = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(released(_bucket_task(length, kind.unit)), f"doc_id {id_kind}, print long, start long, end long")


def passages(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """``doc_id, print, n_words``: words that lie in a string of so many words that also starts elsewhere, for the documents that have any."""
    found = spans(docs, words * WORD, Words).distinct().groupBy("doc_id", "print").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["upto"], x["end"]).alias("upto"), (a["n"] + F.greatest(x["end"] - F.greatest(a["upto"], x["start"]), F.lit(0).cast("long"))).alias("n"))
    return found.select("doc_id", "print", (F.aggregate("spans", zero, step)["n"] / WORD).cast("long").alias("n_words"))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return start[fresh], end[np.append(fresh[1:], len(start)) - 1]


def remaining(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, print, n_bytes, n_removed, n_spans, kept_sha256, kept binary`` of every row; ``kept`` is null where nothing is removed."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(spark, spans(docs, length), "spans")
    shared = spark.sparkContext.broadcast(bit_filter(found.select("print").distinct(), "print"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                prints = fingerprints(chunk)
                wanted = in_filter(raw, prints) & (np.diff(chunk.off) >= length)
                texts = [chunk.data[chunk.off[d] : chunk.off[d + 1]].tobytes() for d in range(len(chunk))]
                sums = [None if w else hashlib.sha256(t).hexdigest() for t, w in zip(texts, wanted, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(chunk.first, len(chunk)), pa.array(prints), pa.array(np.diff(chunk.off)), pa.array(sums, pa.string()),
                        pa.array([t if w else None for t, w in zip(texts, wanted, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "print", "n_bytes", "sha", "data"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans, sums, kept = [], [], [], []
            for data, sha, places in zip(batch.column("data").to_pylist(), batch.column("sha").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if data is None or not places:
                    removed.append(0)
                    n_spans.append(0)
                    sums.append(sha or hashlib.sha256(data or b"").hexdigest())
                    kept.append(None)
                    continue
                start, end = merged(np.array([p["start"] for p in places]), np.array([p["end"] for p in places]))
                rest = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True))
                removed.append(int((end - start).sum()))
                n_spans.append(len(start))
                sums.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("print"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sums), pa.array(kept, pa.binary())],
                ["doc_id", "print", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    # spans of a document are at most as many as its bytes; equal rows share theirs
    grouped = found.distinct().groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    every = docs.mapInArrow(released(candidates), f"doc_id {kind}, print long, n_bytes long, sha string, data binary")
    joined = every.where("data IS NOT NULL").join(grouped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")), "left").drop("_id", "_print")
    schema = f"doc_id {kind}, print long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    rest = every.where("data IS NULL").select("doc_id", "print", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    return joined.mapInArrow(released(cut), schema).unionByName(rest)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and ``n_passage_words``: words in passages of 50 words or more that stand elsewhere too, of any number of bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    repeated = written(spark, passages(docs), "passages").select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "n_words")
    rows = remaining(docs, 400).drop("kept")
    joined = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")), "left")
    return joined.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_passage_words"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
