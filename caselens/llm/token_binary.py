"""Token-id output as Simple-8b shards.

Texts are encoded, put in ascending document order and written as one binary
shard per partition.  Ids are packed into 64-bit words: the top four bits
select how many equally wide ids share the lower sixty.  Blocks of
``BLOCK_IDS`` ids start at recorded word offsets, so a reader decodes all
blocks of a slice at once with numpy.

Shard layout (little-endian): ``MAGIC``; the words of all blocks; the index:
word offset of each block (uint64), ids of each document (uint64), document
ids (int64), their presence (uint8); a footer of six uint64 - words, blocks,
documents, ids, ids per block, format version - and ``MAGIC`` again.

Defined cases: a null text is an empty one (its document holds the end id
only); a null ``doc_id`` sorts first and comes back null; equal ``doc_id``s
are ordered by text; an empty table gives no rows.  Other columns are ignored.

Text is cut before a blank or line feed that follows a non-space character,
and between a letter and ASCII punctuation.  No pre-token of a byte-level BPE
with the usual word pattern crosses such a cut, so each distinct piece is
encoded once and its ids are reused.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import byte_table, chunks, released, shared_folder, worker_cache

MAGIC = b"S8BSHARD"
VERSION = 1
BLOCK_IDS = 256
FOOTER = 6 * 8 + len(MAGIC)
#: ids per word and bits per id of each selector; selector 0 is the escape: the next word is one raw id
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_U = np.uint64


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs (0 for 0), without rounding through floats above 2**52."""
    high = (ids >> _U(32)).astype(np.float64)
    low = (ids & _U(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each position the selector that packs the most ids from there on."""
    best = np.full(len(bits), 15, np.uint8)
    most, width = bits, 1
    by_count = {1: bits}
    for count in sorted(set(COUNTS.tolist()) - {1}):
        while width < count:  # running maximum over ``width`` ids, widened by what is still missing
            step = min(width, count - width)
            wider = most.copy()
            np.maximum(most[:-step], most[step:], out=wider[:-step])
            most, width = wider, width + step
        by_count[count] = most
    for s in range(14, 0, -1):
        best[by_count[int(COUNTS[s])] <= WIDTHS[s]] = s
    best[bits > 60] = 0
    return best


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, and the words in each block.  The last block may be short."""
    ids = np.ascontiguousarray(ids, _U)
    n = len(ids)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    blocks = -(-n // block_ids)
    pad = int(COUNTS.max())
    grid = np.zeros((blocks, block_ids + pad), _U)
    flat = np.zeros(blocks * block_ids, _U)
    flat[:n] = ids
    grid[:, :block_ids] = flat.reshape(blocks, block_ids)
    size = np.full(blocks, block_ids)
    size[-1] = n - (blocks - 1) * block_ids
    width = grid.shape[1]
    values = grid.ravel()
    best = _selectors(_bits(values))
    at = np.arange(blocks) * width
    end = at + size
    active = np.arange(blocks)
    filled = np.zeros(blocks, np.int64)
    out = np.zeros((blocks, block_ids * 2), _U)
    while len(active):
        p = at[active]
        s = best[p].astype(np.int64)
        word = s.astype(_U) << _U(60)
        for k in np.unique(s):
            rows = np.flatnonzero(s == k)
            if k == 0:
                out[active[rows], filled[active[rows]] + 1] = values[p[rows]]
            elif WIDTHS[k]:
                shifts = (np.arange(COUNTS[k]) * WIDTHS[k]).astype(_U)
                parts = values[p[rows, None] + np.arange(COUNTS[k])] << shifts
                word[rows] |= np.bitwise_or.reduce(parts, axis=1)
        out[active, filled[active]] = word
        filled[active] += 1 + (s == 0)
        at[active] = p + COUNTS[s]
        active = active[at[active] < end[active]]
    return out[np.arange(out.shape[1]) < filled[:, None]], filled


def unpack(words: np.ndarray, block_words: np.ndarray, n: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The ``n`` ids of consecutive blocks, all but the last of ``block_ids`` ids."""
    words = np.ascontiguousarray(words, _U)
    if not n:
        return np.zeros(0, _U)
    blocks = len(block_words)
    selector = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():  # a raw word may look like anything: walk the words of the blocks that may hold one
        first = np.concatenate(([0], np.cumsum(block_words)))
        for b in np.unique(np.searchsorted(first, np.flatnonzero(selector == 0), "right") - 1):
            i = int(first[b])
            while i < first[b + 1]:
                if selector[i] == 0:
                    raw[i + 1] = True
                    i += 1
                i += 1
    counts = np.where(raw, 0, COUNTS[selector])
    before = np.cumsum(counts) - counts
    of = np.repeat(np.arange(blocks), block_words)
    first_word = np.concatenate(([0], np.cumsum(block_words)[:-1]))
    at = of * block_ids + before - before[first_word][of]
    limit = np.minimum((of + 1) * block_ids, n)
    out = np.zeros(n, _U)
    for k in range(16):
        rows = np.flatnonzero((selector == k) & ~raw)
        if not len(rows):
            continue
        if k == 0:
            out[at[rows]] = words[rows + 1]
            continue
        if not WIDTHS[k]:
            continue
        lanes = np.arange(COUNTS[k])
        mask = _U((1 << int(WIDTHS[k])) - 1)
        values = (words[rows, None] >> (lanes * WIDTHS[k]).astype(_U)) & mask
        to = at[rows, None] + lanes
        ok = to < limit[rows, None]
        out[to[ok]] = values[ok]
    return out


# -- shards ---------------------------------------------------------------


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class ShardWriter:
    """Streams one shard; it counts only once ``close`` has moved it to its name."""

    SLAB = BLOCK_IDS * 4096

    def __init__(self, folder: str):
        self.fs, root = _filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.s8b"
        self.path = f"{root}/{self.name}"
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.out.write(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_words = self.n_ids = 0
        self.block_words: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.known: list[np.ndarray] = []

    def add(self, docs: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.asarray(docs, np.int64))
        self.known.append(np.asarray(known, np.uint8))
        self.lengths.append(np.asarray(lengths, np.uint64))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.SLAB:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, whole, self.SLAB):
                self._blocks(ids[i : min(i + self.SLAB, whole)])
            self.held, self.n_held = [ids[whole:].copy()], len(ids) - whole

    def _blocks(self, ids: np.ndarray) -> None:
        words, sizes = pack(ids)
        self.out.write(words.astype("<u8").tobytes())
        self.block_words.append(sizes)
        self.n_words += len(words)
        self.n_ids += len(ids)

    def close(self) -> None:
        if self.n_held:
            rest = np.concatenate(self.held)
            for i in range(0, len(rest), self.SLAB):
                self._blocks(rest[i : i + self.SLAB])
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        sizes = join(self.block_words, "<u8")
        offsets = np.cumsum(sizes) - sizes
        docs = join(self.docs, "<i8")
        for part in (offsets.astype("<u8"), join(self.lengths, "<u8"), docs, join(self.known, "<u1")):
            self.out.write(part.tobytes())
        footer = np.array([self.n_words, len(offsets), len(docs), self.n_ids, BLOCK_IDS, VERSION], "<u8")
        self.out.write(footer.tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.path + ".part")


class ShardReader:
    """Random and streaming access to one shard."""

    def __init__(self, uri: str):
        self.fs, path = _filesystem(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(FOOTER, size - FOOTER)
        if tail[-len(MAGIC) :] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no Simple-8b shard")
        self.n_words, blocks, docs, self.n_ids, self.block_ids, version = (int(x) for x in np.frombuffer(tail, "<u8", 6))
        if version != VERSION:
            raise ValueError(f"{uri} has format version {version}")
        at = len(MAGIC) + 8 * self.n_words
        index = self.file.read_at(size - FOOTER - at, at)
        self.block_at = np.append(np.frombuffer(index, "<u8", blocks), self.n_words).astype(np.int64)
        self.lengths = np.frombuffer(index, "<u8", docs, 8 * blocks).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", docs, 8 * (blocks + docs))
        self.known = np.frombuffer(index, "<u1", docs, 8 * (blocks + 2 * docs)).astype(bool)
        self.doc_at = np.concatenate(([0], np.cumsum(self.lengths)))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start:end`` of the shard, decoded from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, _U)
        a, b = start // self.block_ids, -(-end // self.block_ids)
        at = self.block_at[a : b + 1]
        words = np.frombuffer(self.file.read_at(int(at[-1] - at[0]) * 8, len(MAGIC) + 8 * int(at[0])), "<u8")
        n = min(b * self.block_ids, self.n_ids) - a * self.block_ids
        return unpack(words, np.diff(at), n, self.block_ids)[start - a * self.block_ids : end - a * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.doc_at[k]), int(self.doc_at[k + 1]))

    def slices(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end document, their ids), at most about ``most`` ids unless one document is longer."""
        k = 0
        while k < len(self.docs):
            end = int(np.searchsorted(self.doc_at, self.doc_at[k] + most, "right")) - 1
            end = min(len(self.docs), max(end, k + 1))
            yield k, end, self.ids(int(self.doc_at[k]), int(self.doc_at[end]))
            k = end


# -- encoding -------------------------------------------------------------

_LETTER = byte_table((0x41, 0x5A), (0x61, 0x7A))
_PUNCTUATION = byte_table((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: pieces of one generation; a worker keeps two generations with their ids
CACHE_PIECES = 350_000
#: bytes of text that are encoded at once, as fewer distinct pieces are looked up in longer stretches
STRETCH_BYTES = 4 << 20
_JOINABLE = re.compile(rb" [!-~\xc3-\xdf][!-~\x80-\xff]*(?<=[!-~])", re.S).fullmatch


class PieceEncoder:
    """Ids of texts by the tokenizers library, each distinct piece encoded once while the cache holds it."""

    def __init__(self, tokenizer_file: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1, np.int64)
        self.used = np.zeros(0, bool)  # found or learnt in this generation
        self.old = 0  # pieces of the last generation

    def _age(self) -> None:
        """Starts a generation: pieces that the last one neither found nor learnt are forgotten."""
        kept = [(p, k) for p, k in self.known.items() if self.used[k]]
        number = np.fromiter((k for _, k in kept), np.int64, len(kept))
        flat, lengths = self._gather(number)
        self.flat = flat
        self.at = np.concatenate(([0], np.cumsum(lengths)))
        self.known = {p: k for k, (p, _) in enumerate(kept)}
        self.used = np.zeros(len(kept), bool)
        self.old = len(kept)

    def _gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and how many each has."""
        begin = self.at[number]
        lengths = self.at[number + 1] - begin
        upto = np.cumsum(lengths) - lengths
        return self.flat[np.arange(lengths.sum()) + np.repeat(begin - upto, lengths)], lengths

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that start with one blank and end in visible ASCII: their concatenation is cut between them again."""
        texts = [b"".join(pieces[i : i + 256]).decode() for i in range(0, len(pieces), 256)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(self.width[ids])
        upto = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))) + 1
        return ids, np.diff(upto, prepend=0)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of pieces that were not known."""
        split: tuple[list[int], list[int]] = ([], [])
        for k, piece in enumerate(pieces):
            split[_JOINABLE(piece) is None].append(k)
        order = np.array(split[0] + split[1], np.int64)
        parts = [self._joined([pieces[k] for k in split[0]])] if split[0] else []
        for i in range(0, len(split[1]), 4096):
            batch = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[k].decode() for k in split[1][i : i + 4096]], add_special_tokens=False)]
            parts.append((np.fromiter((i for ids in batch for i in ids), np.uint32), np.fromiter(map(len, batch), np.int64, len(batch))))
        lengths = np.concatenate([n for _, n in parts])
        total = int(lengths.sum())
        used = int(self.at[-1])
        if used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(max(total, used), np.uint32)])
        self.flat[used : used + total] = np.concatenate([ids for ids, _ in parts])
        number = np.empty(len(pieces), np.int64)
        number[order] = np.arange(len(self.at) - 1, len(self.at) - 1 + len(pieces))
        self.at = np.concatenate([self.at, used + np.cumsum(lengths)])
        self.used = np.concatenate([self.used, np.zeros(len(pieces), bool)])
        self.known.update(zip(pieces, number.tolist(), strict=True))
        return number

    def cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Offsets at which pieces start, each document's start among them, and the end of the data."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 1:
            gap = (data == 0x20) | (data == 0x0A)
            solid = (data > 0x20) & (data < 0x7F)
            wide = np.flatnonzero(data >= 0xC0)  # the last byte of a character that can't be white space
            wide = wide[(data[wide] > 0xC2) & ((data[wide] < 0xE1) | (data[wide] > 0xE3))]
            last = wide + np.where(data[wide] < 0xE0, 1, np.where(data[wide] < 0xF0, 2, 3))
            solid[last[last < n]] = True
            letter = _LETTER[data]
            accented = np.flatnonzero(data[:-1] == 0xC3) + 1
            letter[accented[(data[accented] != 0x97) & (data[accented] != 0xB7)]] = True
            cut[1:n] = gap[1:] & solid[:-1] | _PUNCTUATION[data[1:]] & letter[:-1]
            for special in self.specials:  # a special token's string takes its neighbours as they stand
                if (data == special[0]).any() and special in (raw := data.tobytes()):
                    p = raw.find(special)
                    while p >= 0:
                        d = int(np.searchsorted(off, p, "right")) - 1
                        cut[off[d] : off[d + 1]] = False
                        p = raw.find(special, int(off[d + 1]))
        cut[off] = True
        cut[n] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, and how many each has."""
        at = self.cuts(data, off)
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) - self.old + len(distinct) > CACHE_PIECES:
            self._age()
        find = self.known.get
        number = np.fromiter((find(p, -1) for p in distinct), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._learn([distinct[k] for k in new.tolist()])
        self.used[number] = True
        ids, lengths = self._gather(number[coded.indices.to_numpy()])
        upto = np.concatenate(([0], np.cumsum(lengths)))
        of = np.searchsorted(at[:-1], off)
        return ids, upto[of[1:]] - upto[of[:-1]]


_encoders: dict[str, PieceEncoder] = worker_cache("token_binary")


def piece_encoder(tokenizer_file: str) -> PieceEncoder:
    if tokenizer_file not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_file] = PieceEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


# -- the operator ---------------------------------------------------------


def write_token_shards(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 0, partitions: int | None = None) -> list[dict]:
    """Encodes ``text`` and writes shards in ascending ``doc_id`` order below ``folder``.

    Returns the manifest: per shard its ``name``, ``n_docs``, ``n_ids`` and
    ``start`` (ids in the shards before it).  It has one entry a partition.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, first, total = piece_encoder(tokenizer_file), None, None, 0
        try:
            for batch in batches:
                doc = batch.column("doc_id")
                for chunk in chunks(batch.column("text"), STRETCH_BYTES):
                    writer = writer or ShardWriter(folder)
                    ids, lengths = encoder.encode(chunk.data, chunk.off)
                    ends = np.cumsum(lengths)
                    ids = np.insert(ids, ends, end_id)
                    rows = doc.slice(chunk.first, len(chunk))
                    numbers = rows.fill_null(0).to_numpy(zero_copy_only=False)
                    writer.add(numbers, rows.is_valid().to_numpy(zero_copy_only=False), lengths + 1, ids)
                    if first is None:
                        first = rows[0].as_py()
                    total += len(chunk)
            if writer:
                writer.close()
                order = -(1 << 63) if first is None else first
                yield pa.RecordBatch.from_pydict({"name": [writer.name], "first": [order], "null_first": [first is None], "n_docs": [total], "n_ids": [writer.n_ids]})
        except BaseException:
            if writer:
                writer.abort()
            raise

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    done = ordered.mapInArrow(released(write, "token_binary"), "name string, first long, null_first boolean, n_docs long, n_ids long")
    manifest = sorted((r.asDict() for r in done.collect()), key=lambda r: (not r["null_first"], r["first"]))
    start = 0
    for entry in manifest:
        entry["start"] = start
        start += entry["n_ids"]
    return manifest


def read_token_shards(spark: SparkSession, folder: str, manifest: list[dict], digest: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """One row a document from the shards: ``doc_id, start, n_tokens, ids_crc32``.

    ``digest`` maps a document's ids to a long; the default is crc32 over the
    ids as little-endian 32-bit integers.
    """
    digest = digest or (lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
    shards = [(m["name"], m["start"]) for m in manifest]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                name, start = shards[k]
                shard = ShardReader(f"{folder}/{name}")
                for a, b, ids in shard.slices():
                    at = shard.doc_at[a : b + 1] - shard.doc_at[a]
                    ids = ids.astype(np.uint32)
                    sums = [digest(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.docs[a:b], pa.int64(), mask=~shard.known[a:b]), pa.array(start + shard.doc_at[a:b]), pa.array(shard.lengths[a:b]), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(released(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "tokens")
    manifest = write_token_shards(docs, folder, str(public_tokenizers.path("byte_bpe_50k.json")))
    return read_token_shards(spark, folder, manifest)


QUERIES = {"op10_token_binary": op10_token_binary}
ORACLE_SQL: dict[str, str] = {}
