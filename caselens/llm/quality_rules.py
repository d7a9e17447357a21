"""Quality rules: base counts and n-gram perplexity bands.

The language model is an interpolated modified Kneser-Ney bigram model (three
discounts at either order), with words kept apart by language.  Spark counts it
over all rows, each distinct text of a language once, so copies don't make
their own words likely.  Documents go in numbered batches.  A batch sends its
sorted distinct bigrams with their counts to the shards of their first words.  A
shard merges them, notes where each batch's bigrams stand in the merged order,
and asks the shards of the second words what number of words each of them
follows.  Then it makes the bits of each bigram, in whole numbers of ``1 / UNIT``
bit so that the order of sums doesn't matter, and answers each batch with those
of its bigrams, in the batch's order.  Shards take turns in counting, and then the
documents are read once more, and a batch sums its bits by document.  So a
bigram's hashes travel once, nothing is cut and the model is broadcast nowhere.  Words are 48-bit hashes: among a billion
different words some 1,800 pairs are taken for one.

Documents have to come in the same partitions and order each time they are read,
as from files; batches that differ are refused.

A document is kept if it passes the base rule and its perplexity lies inside
the band of its language.  Over the documents that pass the base rule, the upper
bound is the median of log2 perplexity plus ``UPPER_SPREADS`` times its spread
(upper quartile less median, / 0.6745).  The lower bound is the median of the
*distinct* texts, so copies don't move it, less ``LOWER_SPREADS`` times their
spread (median less lower quartile, / 0.6745).  Spreads are ``LEAST_SPREAD`` at
least.

Defined cases: a null or empty text has no words and fails the base rule; a
null ``lang``, or a table without that column, is a language of its own; equal
rows are counted and returned each; other columns are ignored by ``assess``.
"""

from __future__ import annotations

import hashlib
import time
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import LOWER, NOT_SPACE, Chunk, bit_filter, byte_table, chunks, combine, discard, in_filter, mix, per_document, released, rolling_prefix, span_hash, written

#: words after which a batch of documents is sent
BATCH_WORDS = 2 << 20
#: the shards are counted in so many turns, as all bigrams at once would take more disk
ROUNDS = 3
#: bits are summed in whole numbers of 1 / UNIT
UNIT = 1 << 9
LOWER_SPREADS, UPPER_SPREADS, LEAST_SPREAD = 8.0, 5.5, 0.25
#: log2 perplexity is compared in steps of 1/64
STEPS = 64
MIN_WORDS = 50
_SYMBOL = byte_table("#*$%&|<>")
_U = np.uint64
#: kinds of rows: bigrams of a batch; merged counts, numbers of words followed and places of a batch, in the order a shard needs them; asked words; totals
SENT, MERGED, FOLLOWED, PLACES, ASKED, TOTALS = range(6)


# -- base counts ----------------------------------------------------------


def base_counts(chunk: Chunk, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    data, off = chunk.data, chunk.off
    starts, ends, at = words
    inside = NOT_SPACE[data]
    chars = per_document(inside & ((data & 0xC0) != 0x80), off)
    symbols = per_document(_SYMBOL[data], off)
    prefix = rolling_prefix(data)
    hashes = span_hash(prefix, starts, ends, data)
    threes = combine([hashes[:-2], hashes[1:-1], hashes[2:]]) if len(hashes) > 2 else hashes[:0]
    inside_before = np.concatenate(([0], np.cumsum(inside)))
    newline = np.flatnonzero(data == 0x0A)
    line_at = np.searchsorted(newline, off)
    n = np.diff(at)
    repeated, dup_lines = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for d in np.flatnonzero(n):
        a, b = at[d], at[d + 1]
        if b - a > 3:
            own = threes[a : b - 2]
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            if same.any():
                hit = np.zeros(b - a, bool)
                found = np.concatenate((order[1:][same], order[:-1][same]))
                for k in range(3):
                    hit[found + k] = True
                repeated[d] = hit.sum()
        breaks = newline[line_at[d] : line_at[d + 1]]
        if len(breaks):
            begin = np.concatenate(([off[d]], breaks + 1))
            until = np.concatenate((breaks, [off[d + 1]]))
            worded = inside_before[until] > inside_before[begin]
            lines = span_hash(prefix, begin[worded], until[worded], data)
            dup_lines[d] = len(lines) - len(np.unique(lines))
    return np.column_stack([n, chars, symbols, dup_lines, repeated])


# -- bigrams --------------------------------------------------------------


def _seed(lang: str | None) -> int:
    name = b"" if lang is None else b"=" + lang.encode()
    return int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little")


def bigrams(chunk: Chunk, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hashes of the first and second words of all documents' bigrams in a row, and the documents' offsets.  A start mark precedes each document."""
    low = LOWER[chunk.data]
    starts, ends, at = chunk.words(NOT_SPACE)
    seeds = np.array([_seed(x) for x in langs], _U)
    words = span_hash(rolling_prefix(low), starts, ends, low)
    second = mix(words ^ np.repeat(seeds, np.diff(at))) >> _U(16)
    first = np.empty_like(second)
    first[1:] = second[:-1]
    begin = at[:-1][np.diff(at) > 0]
    first[begin] = (mix(seeds) >> _U(16))[np.diff(at) > 0]
    return first, second, at


def _ordered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by first and second word, and where new pairs start in it."""
    key = first << _U(16) | second >> _U(32)
    order = np.argsort(key, kind="stable")
    key, own = key[order], second[order]
    mixed = (key[1:] == key[:-1]) & (own[1:] != own[:-1])
    if mixed.any():  # seconds that begin alike
        again = np.isin(key, key[1:][mixed])
        order[again] = order[again][np.lexsort((own[again], key[again]))]
        own = second[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    return order, np.flatnonzero(new) if len(key) else np.zeros(0, np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, as many as the largest needs."""
    values = np.ascontiguousarray(values, _U)
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view(_U).ravel()


def _gaps(values: np.ndarray) -> bytes:
    return _packed(np.diff(values.astype(_U), prepend=_U(0)))


def _ungapped(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob), dtype=_U)


def _shards(spark: SparkSession) -> int:
    """A power of two, as shards are cut by leading bits."""
    return 1 << max(0, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


def _word_shards(shards: int) -> int:
    """Fewer than those of the bigrams, as every bigram shard sends a part to each of them."""
    return max(1, shards // 16)


def _cut(words: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard starts in sorted words."""
    edges = np.arange(1, shards, dtype=np.uint64) << _U(48 - shards.bit_length() + 1)
    return np.concatenate(([0], np.searchsorted(words, edges), [len(words)]))


_ROW = "lang string, shard int, kind int, batch string, blobs array<binary>"


def _row(lang: str | None, shard: int, kind: int, batch: str | None, *blobs: bytes) -> tuple:
    return lang, shard, kind, batch, blobs


#: rows and bytes of blobs that a task sends on together
SENT_ROWS, SENT_BYTES = 512, 4 << 20
_ROW_KINDS = {"lang": pa.string(), "shard": pa.int32(), "kind": pa.int32(), "batch": pa.string(), "blobs": pa.list_(pa.binary())}
_SCORED_KINDS = {"batch": pa.string(), "kind": pa.int32(), "lang": pa.string(), "shard": pa.int32(), "blob": pa.binary()}


def _sent(task, kinds: dict[str, pa.DataType]):
    """A task of rows as one of batches: many small rows would cost more than what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
        for row in task(batches):
            held.append(row)
            size += sum(map(len, row[-1])) if isinstance(row[-1], tuple) else len(row[-1])
            if len(held) >= SENT_ROWS or size > SENT_BYTES:
                yield make()
                held.clear()
                size = 0
        if held:
            yield make()

    return released(run)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one, so that only one row's blobs are Python objects at a time."""
    for batch in batches:
        for k in range(len(batch)):
            yield tuple(batch.column(c)[k].as_py() for c in ("lang", "shard", "kind", "batch", "blobs"))


class _Batch:
    """Consecutive documents: rows of the table, and by language the words with their documents."""

    def __init__(self, task: int, number: int):
        self.task, self.number, self.n_words, self.n_docs = task, number, 0, 0
        self.pieces: list[tuple[pa.RecordBatch, Chunk]] = []
        self.words: dict[str | None, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def take(self, rows: pa.RecordBatch, chunk: Chunk) -> None:
        langs = rows.column("lang").to_pylist()
        first, second, at = bigrams(chunk, langs)
        doc = np.repeat(np.arange(self.n_docs, self.n_docs + len(chunk)), np.diff(at))
        code = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        which = np.repeat(np.array([code[x] for x in langs]), np.diff(at))
        for lang, k in code.items():
            mine = which == k
            if mine.any():
                self.words.setdefault(lang, []).append((first[mine], second[mine], doc[mine]))
        self.n_words, self.n_docs = self.n_words + len(first), self.n_docs + len(chunk)

    @property
    def name(self) -> str:
        check = 0
        for parts in self.words.values():
            for first, second, _ in parts:
                check = zlib.crc32(second, zlib.crc32(first, check))
        return f"{self.task}-{self.number}-{check}"

    def by_language(self) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, np.ndarray]]:
        for lang in list(self.words):
            yield lang, *(np.concatenate(x) for x in zip(*self.words.pop(lang), strict=True))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Batch, list]]:
    """Batches with their (rows, chunk) pieces; the same ones each time the documents are read."""
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    batch, pieces = _Batch(task, 0), []
    for rows in batches:
        for chunk in chunks(rows.column("text")):
            own = rows.slice(chunk.first, len(chunk))
            batch.take(own, chunk)
            pieces.append((own, chunk))
            if batch.n_words > BATCH_WORDS:
                yield batch, pieces
                batch, pieces = _Batch(task, batch.number + 1), []
    if pieces:
        yield batch, pieces


# -- counts ---------------------------------------------------------------


def _count_task(shards: int, turn: int, shared=None):
    """Distinct bigrams of each batch by shard, for the shards of a turn.  Texts in the filter count 0, as they are counted apart; without a filter batches have no name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch, pieces in _batches(batches):
            name = batch.name if shared else None
            counted = np.concatenate([~in_filter(shared.value, own.column("print").to_numpy()) for own, _ in pieces]) if shared else np.ones(batch.n_docs, bool)
            pieces.clear()
            for lang, first, second, doc in batch.by_language():
                own = np.flatnonzero((first >> _U(49 - shards.bit_length())) % _U(ROUNDS) == turn)
                if not len(own):
                    continue
                first, second, doc = first[own], second[own], doc[own]
                order, start = _ordered(first, second)
                counts = np.add.reduceat(counted[doc[order]].astype(np.int64), start)
                first, second = first[order[start]], second[order[start]]
                cut = _cut(first, shards)
                for s in range(shards):
                    own = slice(cut[s], cut[s + 1])
                    if cut[s] < cut[s + 1]:
                        begin = np.flatnonzero(np.diff(first[own], prepend=_U(0xFFFFFFFFFFFFFFFF)))
                        yield _row(lang, s, SENT, name, _gaps(first[own][begin]), _packed(np.diff(np.append(begin, cut[s + 1] - cut[s]))), _packed(second[own]), _packed(counts[own]))

    return run


def _merge_task(shards: int):
    """Shards, from rows sorted by shard and language: merged counts, places of the batches' bigrams, asked words, counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (shard, lang), rows in groupby(_rows(batches), lambda r: (r[1], r[0])):
            names, firsts, seconds, counts = [], [], [], []
            for _, _, _, name, (words, times, second, count) in rows:
                names.append(name)
                firsts.append(np.repeat(_ungapped(words), _unpacked(times).astype(np.int64)))
                seconds.append(_unpacked(second))
                counts.append(_unpacked(count).astype(np.int64))
            size = [len(x) for x in firsts]
            first, second = np.concatenate(firsts), np.concatenate(seconds)
            firsts.clear()
            seconds.clear()
            order, start = _ordered(first, second)
            total = np.add.reduceat(np.concatenate(counts)[order], start)
            place = np.empty(len(order), np.int64)
            place[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
            first, second = first[order[start]], second[order[start]]
            begin = np.flatnonzero(np.diff(first, prepend=_U(0xFFFFFFFFFFFFFFFF)))
            words, index, followed = np.unique(second, return_inverse=True, return_counts=True)
            yield _row(lang, shard, MERGED, None, _packed(np.diff(np.append(begin, len(first)))), _packed(total), _packed(index))
            at = 0
            for name, n in zip(names, size, strict=True):
                if name:
                    yield _row(lang, shard, PLACES, name, _gaps(place[at : at + n]))
                at += n
            cut = _cut(words, _word_shards(shards))
            for s in range(_word_shards(shards)):
                own = slice(cut[s], cut[s + 1])
                if cut[s] < cut[s + 1]:
                    yield _row(lang, s, ASKED, str(shard), _gaps(words[own]), _packed(followed[own]))
            yield _row(lang, shard, TOTALS, None, _packed(np.append(np.bincount(np.minimum(total, 5), minlength=6)[1:5], len(total))))

    return run


def _answer_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """What number of words each word follows, to every shard that asked; the words' number and counts of counts."""
    for (shard, lang), rows in groupby(_rows(batches), lambda r: (r[1], r[0])):
        asked = [(int(asks), _ungapped(words), _unpacked(followed).astype(np.int64)) for _, _, _, asks, (words, followed) in rows]
        words, index = np.unique(np.concatenate([w for _, w, _ in asked]), return_inverse=True)
        followed = np.zeros(len(words), np.int64)
        np.add.at(followed, index, np.concatenate([n for _, _, n in asked]))
        for asks, own, _ in asked:
            yield _row(lang, asks, FOLLOWED, str(shard), _packed(followed[np.searchsorted(words, own)]))
        yield _row(lang, shard, TOTALS, "words", _packed(np.append(np.bincount(np.minimum(followed, 5), minlength=6)[1:5], len(words))))


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """What is taken from a count of 0, 1, 2 and more."""
    n1, n2, n3, n4 = (float(x) for x in counts_of_counts)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    discount = np.array([0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5])
    return np.clip(discount, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.85])


# -- scores ---------------------------------------------------------------


def _bits(each: np.ndarray, counts: np.ndarray, followed: np.ndarray, of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """-log2 probability, in 1 / UNIT, of the merged bigrams of a shard; ``each``: bigrams of each first word; ``of``: totals of the language's bigrams and words."""
    (pairs, types), (kinds_of, kinds) = ((x[:4], int(x[4])) for x in of)
    high, low = discounts(pairs), discounts(kinds_of)
    first = np.cumsum(each) - each
    taken = high[np.minimum(counts, 3)]
    total = np.add.reduceat(counts, first)
    back = np.maximum(np.add.reduceat(taken, first) / total, 1e-6)
    few = kinds_of[:2]
    spread = (low[1] * few[0] + low[2] * few[1] + low[3] * (kinds - few.sum())) / types
    lower = np.maximum((followed - low[np.minimum(followed, 3)]) / types + spread / (kinds + 1), 1e-12)
    p = (counts - taken) / np.repeat(total, each) + np.repeat(back, each) * lower
    return np.rint(-np.log2(np.minimum(p, 1)) * UNIT).astype(np.int64)


_SCORED = "batch string, kind int, lang string, shard int, blob binary"


def _score_task(of: dict[str | None, tuple[np.ndarray, np.ndarray]]):
    """The bits of each batch's bigrams, from rows sorted by shard, language and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (shard, lang), rows in groupby(_rows(batches), lambda r: (r[1], r[0])):
            merged, followed, bits = None, [], None
            for _, _, kind, name, blobs in rows:
                if kind == MERGED:
                    merged = [_unpacked(x).astype(np.int64) for x in blobs]
                elif kind == FOLLOWED:
                    followed.append((int(name), _unpacked(blobs[0]).astype(np.int64)))
                else:
                    if bits is None:
                        each, counts, index = merged
                        numbers = np.concatenate([n for _, n in sorted(followed, key=lambda x: x[0])])
                        bits = _bits(each, counts, numbers[index], of[lang])
                    yield name, 2, lang, shard, _packed(bits[_ungapped(blobs[0]).astype(np.int64)])

    return run


_BASE_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _share_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each batch's documents with their base counts (kind 0), and by language and document the sorted numbers of the words' bigrams among the batch's distinct ones (1)."""
    for batch, pieces in _batches(batches):
        name, tables = batch.name, []
        for own, chunk in pieces:
            counts = base_counts(chunk, chunk.words(NOT_SPACE)).astype(np.int64)
            tables.append(pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("lang"), own.column("print"), *(pa.array(c) for c in counts.T)], ["doc_id", "lang", "print", *_BASE_NAMES]))
        pieces.clear()
        out = pa.BufferOutputStream()
        table = pa.Table.from_batches(tables)
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        yield name, 0, None, 0, out.getvalue().to_pybytes()
        for lang, first, second, doc in batch.by_language():
            order, start = _ordered(first, second)
            number = np.empty(len(order), _U)
            number[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
            number |= doc.astype(_U) << _U(32)
            number.sort()  # sums don't depend on the order of a document's words, and gaps are short
            gaps = np.diff(number, prepend=_U(0))
            begin = np.flatnonzero(np.diff(number >> _U(32), prepend=_U(0xFFFFFFFF)))
            gaps[begin] = number[begin] & _U(0xFFFFFFFF)
            yield name, 1, lang, 0, _packed(gaps)


def _total_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each batch with their perplexity, from rows sorted by batch, kind, language and shard."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for k in range(len(batch)):
                yield tuple(batch.column(c)[k].as_py() for c in ("batch", "kind", "lang", "blob"))

    for name, parts in groupby(rows(), lambda r: r[0]):
        table, gaps, bits = None, {}, {}
        for _, kind, lang, blob in parts:
            if kind == 0:
                table = pa.ipc.open_stream(blob).read_all().combine_chunks()
            elif kind == 1:
                gaps[lang] = _unpacked(blob).astype(np.int64)
            else:
                bits.setdefault(lang, []).append(_unpacked(blob).astype(np.int64))
        if table is None or set(gaps) != set(bits):
            raise RuntimeError(f"the documents of batch {name} were not the same each time they were read")
        n, langs = table.column("n_words").to_numpy(), np.array(table.column("lang").to_pylist(), object)
        sums = np.zeros(len(n), np.int64)
        for lang, index in gaps.items():
            mine = np.flatnonzero(langs == lang)
            end = np.cumsum(n[mine])
            number = np.cumsum(index)
            full = n[mine] > 0
            begin = (end - n[mine])[full]
            number -= np.repeat(number[begin] - index[begin], n[mine][full])
            upto = np.concatenate(([0], np.cumsum(np.concatenate(bits[lang])[number])))
            sums[mine] = upto[end] - upto[end - n[mine]]
        yield from table.append_column("log2_ppl", pa.array(sums / UNIT / np.maximum(n, 1), mask=n == 0)).to_batches()


def scored(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Base counts and ``log2_ppl`` of every row of ``doc_id, lang, text, print``, under the model of all rows; and the tables that they are read from."""
    spark = docs.sparkSession
    shards = _shards(spark)
    texts = docs.select("lang", "print", "text")
    # texts that occur more than once; a wrong hit of the filter only means that a text is counted apart
    repeated = written(spark, docs.groupBy("lang", "print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "repeated")
    shared = spark.sparkContext.broadcast(bit_filter(repeated, "print"))

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(shared.value, batch.column("print").to_numpy())))

    apart = texts.mapInArrow(released(hit), texts.schema).groupBy("lang", "print").agg(F.first("text").alias("text"))
    apart = written(spark, apart.select("lang", "print", "text"), "apart")
    parts = []
    for turn in range(min(ROUNDS, shards)):
        _free_shuffles(spark)
        # the same columns as below, so that rows that were dealt at random come in the same order
        sent = docs.mapInArrow(_sent(_count_task(shards, turn, shared), _ROW_KINDS), _ROW).unionByName(apart.mapInArrow(_sent(_count_task(shards, turn), _ROW_KINDS), _ROW))
        parts.append(written(spark, sent.repartition(shards, "shard").sortWithinPartitions("shard", "lang").mapInArrow(_sent(_merge_task(shards), _ROW_KINDS), _ROW), "counts"))
    discard(apart, repeated)
    _free_shuffles(spark)
    counted = reduce(DataFrame.unionByName, parts)
    asked = counted.where(F.col("kind") == ASKED).repartition(_word_shards(shards), "shard").sortWithinPartitions("shard", "lang")
    answers = written(spark, asked.mapInArrow(_sent(_answer_task, _ROW_KINDS), _ROW), "followed")
    totals: dict = {}
    for lang, _, _, of, blobs in _rows(counted.unionByName(answers).where(F.col("kind") == TOTALS).toArrow().to_batches()):
        held = totals.setdefault(lang, (np.zeros(5, np.int64), np.zeros(5, np.int64)))
        held[of == "words"][:] += _unpacked(blobs[0]).astype(np.int64)
    bits = []
    for turn, table in enumerate(parts):
        state = table.where(F.col("kind").isin(MERGED, PLACES)).unionByName(answers.where((F.col("kind") == FOLLOWED) & (F.col("shard") % ROUNDS == turn)))
        state = state.repartition(shards, "shard").sortWithinPartitions("shard", "lang", "kind")
        bits.append(written(spark, state.mapInArrow(_sent(_score_task(totals), _SCORED_KINDS), _SCORED), "bits"))
        discard(table)
        _free_shuffles(spark)
    discard(answers)
    both = docs.mapInArrow(_sent(_share_task, _SCORED_KINDS), _SCORED).unionByName(reduce(DataFrame.unionByName, bits))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.repartition("batch").sortWithinPartitions("batch", "kind", "lang", "shard").mapInArrow(released(_total_task), f"doc_id {kind}, {_ASSESSED}"), bits


def _free_shuffles(spark: SparkSession) -> None:
    """Spark drops the files of a finished shuffle once the driver's collector has found it unused; Python gives its references up within a second."""
    if not spark.sparkContext.master.startswith("local["):
        time.sleep(2)
    spark.sparkContext._jvm.System.gc()


# -- the rule -------------------------------------------------------------

_ASSESSED = "lang string, print long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log2_ppl double"


def assess(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, ``log2_ppl``, its band (``low``, ``high``) and ``kept`` of every row of ``doc_id, lang, text``."""
    spark = docs.sparkSession
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string")
    docs = docs.select("doc_id", lang.alias("lang"), text.alias("text"), F.xxhash64(text).alias("print"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows, bits = scored(docs)
    found = written(spark, rows.withColumn("base_failed", failed), "perplexity")
    discard(*bits)
    step = F.round(F.col("log2_ppl") * STEPS) / STEPS
    texts = found.where("NOT base_failed").groupBy("lang", "print", step.alias("step")).agg(F.count("*").alias("n"))
    upper = F.percentile("step", F.array(F.lit(0.5), F.lit(0.75)), F.col("n"))
    lower = F.percentile("step", F.array(F.lit(0.5), F.lit(0.25)))
    bands = texts.groupBy(F.col("lang").alias("band_lang")).agg(lower.alias("lower"), upper.alias("upper"))
    spread = lambda q: F.greatest(F.abs(q[1] - q[0]) / 0.6745, F.lit(LEAST_SPREAD))
    low = F.col("lower")[0] - LOWER_SPREADS * spread(F.col("lower"))
    bands = bands.select("band_lang", low.alias("low"), (F.col("upper")[0] + UPPER_SPREADS * spread(F.col("upper"))).alias("high"))
    joined = found.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
    inside = F.coalesce((step >= F.col("low")) & (step <= F.col("high")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept; rows are told apart by id, language and text."""
    mark = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of ``docs``
    keys = {"doc_id": F.col("doc_id"), "lang": F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string"), "print": F.xxhash64(F.col("text").cast("string"))}
    bad = assess(docs).where(~F.col("kept")).select(*(F.col(k).alias(mark + k) for k in keys)).distinct()
    same = [own.eqNullSafe(F.col(mark + k)) for k, own in keys.items()]
    return docs.join(bad, same[0] & same[1] & same[2], "left_anti")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log2_ppl")


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL: dict[str, str] = {}
