"""Benchmark decontamination with an FM-index for each shard of training text.

Test items become phrases: all windows of ``WINDOW`` words, or the whole item
if it has fewer.  A shard is a chunk of documents as a sequence of word
numbers, with a separator after each document.  Its suffix array (prefix
doubling) gives the Burrows-Wheeler transform, which is kept as a wavelet
matrix with ranks.  All phrases are searched backwards at once; rows of the
phrases that occur are walked to the nearest sampled suffix position, which
locates them; overlapping occurrences merge into removal spans.

Words that no test item has can't be part of an occurrence, so a shard's
sequence breaks at them, and runs shorter than the shortest phrase are not
indexed.  Test items are read by the tasks in blocks of at most
``BLOCK_WORDS`` words from the shared folder, one index a shard and block, so
memory does not grow with the benchmark.

Defined cases: a null text has no words; an item without words, or with a null
id, has no phrases; equal items count once by id; repeated documents give a row
each; an empty benchmark hits nothing.  Other columns are ignored by ``find``
and kept by ``remove``.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import ALNUM, LOWER, Chunk, chunks, released, rolling_prefix, shared_folder, span_hash

WINDOW = 10
BLOCK_WORDS = 1 << 20
#: blocks that a worker keeps
KEPT_BLOCKS = 4
#: every so many positions of a shard keep their suffix position
SAMPLE = 8


# -- the index ------------------------------------------------------------


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence whose zeros are separators, each smaller than all words and than later separators."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    zeros = np.flatnonzero(symbols == 0)
    rank += len(zeros)
    rank[zeros] = np.arange(len(zeros))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        value = rank[order]
        fresh = np.concatenate(([True], value[1:] != value[:-1]))
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        # only rows that still tie are sorted on, by the rank ``step`` further
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        rows = order[tied]
        after = np.where(rows + step < n, dense[np.minimum(rows + step, n - 1)], -1)
        again = np.lexsort((after, dense[rows]))
        order[tied] = rows[again]
        # a row's rank is the place of the first row it ties with, so ranks of settled rows stay valid
        key = np.full(n, -1, np.int64)
        key[tied] = after[again]
        new = np.concatenate(([True], (dense[order][1:] != dense[order][:-1]) | (key[1:] != key[:-1]))) if n else fresh
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence; all methods take arrays."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def ranks(self, symbols: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each place."""
        base, places = np.zeros(len(symbols), np.int64), list(places)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbols >> (self.levels - 1 - level) & 1).astype(bool)
            down = lambda at: np.where(bit, zeros + ones[at], at - ones[at])  # noqa: B023, E731
            base, places = down(base), [down(at) for at in places]
        return [at - base for at in places]

    def access(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbols, base = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        at = places.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] > ones[at]
            base = np.where(bit, zeros + ones[base], base - ones[base])
            at = np.where(bit, zeros + ones[at], at - ones[at])
            symbols = symbols << 1 | bit
        return symbols, at - base


class FMIndex:
    """Backward search and location in a sequence of symbols 0 (separator) to ``top``; the sequence ends with a separator."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n = len(symbols)
        suffixes = suffix_array(symbols)
        self.bwt = WaveletMatrix(symbols[suffixes - 1], top)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        kept = suffixes % SAMPLE == 0
        kept |= (suffixes == 0) | (symbols[suffixes - 1] == 0)  # starts of runs: no walk passes a separator
        self.sampled = kept
        self.sample_rank = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)))
        self.samples = suffixes[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of phrases, given as rows of symbols right-aligned in a matrix."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        active = np.flatnonzero((phrases[:, -1] > 0) if phrases.shape[1] else np.zeros(len(phrases), bool))
        high[np.setdiff1d(np.arange(len(phrases)), active)] = 0
        for k in range(1, phrases.shape[1] + 1):
            going = active[lengths[active] >= k]
            if not len(going):
                break
            symbol = phrases[going, -k]
            a, b = self.bwt.ranks(symbol, low[going], high[going])
            low[going], high[going] = self.before[symbol] + a, self.before[symbol] + b
            active = going[low[going] < high[going]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out = np.empty(len(rows), np.int64)
        at, walked, open_ = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(open_):
            done = self.sampled[at]
            out[open_[done]] = self.samples[self.sample_rank[at[done]]] + walked[done]
            open_, at, walked = open_[~done], at[~done], walked[~done] + 1
            symbol, rank = self.bwt.access(at)
            at = self.before[symbol] + rank
        return out


# -- phrases --------------------------------------------------------------


class Phrases:
    """Distinct windows of a block of test items: word numbers (1 up, by sorted hash) and the items that have them."""

    def __init__(self, items: list[tuple[str, str]]):
        hashes, windows, owners = [], [], []
        for chunk in chunks(pa.array([text for _, text in items], pa.string())):
            words, at = word_hashes(chunk)
            for d in range(len(chunk)):
                own = words[at[d] : at[d + 1]]
                hashes.append(own)
                size = min(WINDOW, len(own))
                for k in range(len(own) - size + 1 if size else 0):
                    windows.append(own[k : k + size])
                    owners.append(chunk.first + d)
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        grid = np.zeros((len(windows), WINDOW), np.int64)
        for row, window in enumerate(windows):
            grid[row, WINDOW - len(window) :] = np.searchsorted(self.vocabulary, window) + 1
        self.grid, inverse = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
        self.lengths = (self.grid > 0).sum(axis=1)
        pairs = np.unique(np.column_stack([inverse.ravel(), [number[items[o][0]] for o in owners]]).astype(np.int64), axis=0) if owners else np.zeros((0, 2), np.int64)
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(self.grid) + 1))
        self.items = pairs[:, 1]

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, names=np.array(self.names, dtype=str), vocabulary=self.vocabulary, grid=self.grid, lengths=self.lengths, item_at=self.item_at, items=self.items)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Phrases:
        self = cls.__new__(cls)
        held = np.load(io.BytesIO(raw))
        for name in ("vocabulary", "grid", "lengths", "item_at", "items"):
            setattr(self, name, held[name])
        self.names = held["names"].tolist()
        return self


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[chunk.data]
    starts, ends, at = Chunk(low, chunk.off, chunk.first).words(ALNUM)
    return span_hash(rolling_prefix(low), starts, ends, low), at


def occurrences(words: np.ndarray, at: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase, first word and end word of every occurrence in a shard of documents (word hashes and document offsets)."""
    none = np.zeros(0, np.int64)
    if not len(phrases.grid) or not len(words):
        return none, none, none
    place = np.minimum(np.searchsorted(phrases.vocabulary, words), len(phrases.vocabulary) - 1)
    symbols = np.where(phrases.vocabulary[place] == words, place + 1, 0)
    # runs of test words within documents, at least as long as the shortest phrase
    inside = symbols > 0
    cut = np.zeros(len(words) + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    long = ends - starts >= phrases.lengths.min()
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none, none, none
    length = ends - starts + 1  # with its separator
    base = np.cumsum(length) - length
    origin = np.arange(length.sum()) + np.repeat(starts - base, length)
    sequence = np.where(np.arange(length.sum()) == np.repeat(base + length - 1, length), 0, symbols[np.minimum(origin, len(words) - 1)])
    index = FMIndex(sequence, int(sequence.max()))
    known = (phrases.grid <= sequence.max()).all(axis=1)
    low, high = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    low[known], high[known] = index.search(phrases.grid[known], phrases.lengths[known])
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
    first = origin[index.locate(rows)]
    return which, first, first + phrases.lengths[which]


# -- operators ------------------------------------------------------------


def _stored(benchmark: DataFrame, folder: str) -> list[str]:
    """Tasks write the items in blocks of about ``BLOCK_WORDS`` words below ``folder``; returns the files, one a block."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = rows.agg(F.sum(F.length("t") / 4 + 1)).first()[0] or 0
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, root = pafs.FileSystem.from_uri(folder)
        paths, held, words = [], [], 0

        def put() -> None:
            paths.append(f"{root}/{uuid.uuid4().hex}.npz")
            with own.open_output_stream(paths[-1]) as out:
                out.write(Phrases(held).save())

        for batch in batches:
            for item, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
                held.append((item, text))
                words += len(text) // 4 + 1
                if words > 2 * BLOCK_WORDS:
                    put()
                    held, words = [], 0
        if held:
            put()
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    dealt = rows.repartition(max(1, int(size // BLOCK_WORDS) + 1))
    return [r.path for r in dealt.mapInArrow(released(store), "path string").collect()]  # a path for each million words


class _Blocks:
    """The stored blocks; a few are kept in the worker."""

    kept: dict[str, Phrases] = {}

    def __init__(self, folder: str, paths: list[str]):
        self.folder, self.paths = folder, paths

    def __iter__(self) -> Iterator[Phrases]:
        kept = _Blocks.kept
        for path in self.paths:
            if path not in kept:
                fs, _ = pafs.FileSystem.from_uri(self.folder)
                with fs.open_input_file(path) as f:
                    phrases = Phrases.load(f.read())
                while len(kept) >= KEPT_BLOCKS:
                    del kept[next(iter(kept))]
                kept[path] = phrases
            yield kept[path]


class _Hits:
    """The words of a chunk, which of them are hit, and the items of each document."""

    def __init__(self, chunk: Chunk):
        low = LOWER[chunk.data]
        self.chunk = chunk
        starts, ends, self.at = Chunk(low, chunk.off, chunk.first).words(ALNUM)
        self.places = np.column_stack([starts, ends])
        self.words = span_hash(rolling_prefix(low), starts, ends, low)
        self.change = np.zeros(len(self.words) + 1, np.int64)
        self.items: dict[int, set[str]] = {}

    def add(self, phrases: Phrases) -> None:
        which, first, end = occurrences(self.words, self.at, phrases)
        np.add.at(self.change, first, 1)
        np.add.at(self.change, end, -1)
        doc = np.searchsorted(self.at, first, "right") - 1
        for d, p in np.unique(np.column_stack([doc, which]), axis=0).tolist():
            self.items.setdefault(d, set()).update(phrases.names[k] for k in phrases.items[phrases.item_at[p] : phrases.item_at[p + 1]])

    @property
    def hit(self) -> np.ndarray:
        return np.cumsum(self.change[:-1]) > 0


def _hits(texts: pa.Array, blocks: _Blocks) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, dict[int, set[str]]]]:
    """Chunk, word places, whether each word is hit, document offsets in them, and items of each document; every block is gone through once for all chunks of a batch."""
    found = [_Hits(chunk) for chunk in chunks(texts)]
    for phrases in blocks:
        for x in found:
            x.add(phrases)
    for x in found:
        yield x.chunk, x.places, x.hit, x.at, x.items


def _spans(words: np.ndarray, hit: np.ndarray, at: np.ndarray, d: int, base: int) -> list[tuple[int, int]]:
    """Byte spans, in the document, of its runs of hit words."""
    own = hit[at[d] : at[d + 1]]
    edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
    return [(int(words[at[d] + a, 0]) - base, int(words[at[d] + b - 1, 1]) - base) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, items array<string>, spans array<struct<start,end>>`` (code points) of every row."""
    folder = shared_folder(docs.sparkSession, "phrases")
    blocks = _Blocks(folder, _stored(benchmark, folder))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, hit, at, items in _hits(batch.column("text"), blocks):
                total = np.concatenate(([0], np.cumsum(hit)))
                spans: list[list] = [[] for _ in range(len(chunk))]
                for d in items:
                    base = int(chunk.off[d])
                    chars = np.concatenate(([0], np.cumsum((chunk.data[base : chunk.off[d + 1]] & 0xC0) != 0x80)))
                    spans[d] = [{"start": int(chars[a]), "end": int(chars[b])} for a, b in _spans(words, hit, at, d, base)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(chunk.first, len(chunk)), pa.array(np.diff(at).astype(np.int64)), pa.array((total[at[1:]] - total[at[:-1]]).astype(np.int64)),
                        pa.array([sorted(items.get(d, ())) for d in range(len(chunk))], pa.list_(pa.string())), pa.array(spans, kind),
                    ],
                    ["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(released(run), schema)


def remove(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without the removal spans: the words of test passages and what stands between them."""
    folder = shared_folder(docs.sparkSession, "phrases")
    blocks = _Blocks(folder, _stored(benchmark, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_column)
            column = batch.column(place)
            changed: dict[int, str] = {}
            for chunk, words, hit, at, items in _hits(column, blocks):
                for d in items:
                    base = int(chunk.off[d])
                    raw, end, parts = chunk.data[base : chunk.off[d + 1]].tobytes(), 0, []
                    for a, b in _spans(words, hit, at, d, base):
                        parts.append(raw[end:a])
                        end = b
                    changed[chunk.first + d] = b"".join([*parts, raw[end:]]).decode()
            if changed:
                values = column.to_pylist()
                for row, text in changed.items():
                    values[row] = text
                column = pa.array(values, column.type)
            yield batch.set_column(place, batch.schema.field(place), column)

    return docs.mapInArrow(released(run), docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""
_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM phrases),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT p.doc_id, p.i, p.size, q.item_id FROM places p JOIN phrases q USING (phrase, size)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL = {"op4_decontaminate": _SQL}
