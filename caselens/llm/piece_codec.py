"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Text is cut into marked words: blanks (each a mark, with the one that the model
puts before the text) and what follows them up to the next blank, or to a pair
of characters that no piece has side by side.  No piece has a mark after
another character either, so words are encoded by themselves, and the distinct
words of a batch once each.  They are sorted, which lines up their
trie depth-first, and each keeps the forward states of the prefix that it
shares with the word before it; only its own end is worked out.

The pieces that end at a prefix come from an automaton of all pieces, whose
state is part of the forward state.  The rest of it is, for a unigram model, the best score of a
segmentation and its last piece.  For a BPE model it is the last piece of the
prefix's own encoding: the one piece that ends there and stands beside the last
piece of the prefix before it as merging the two would leave them.  (Maximal
scores would not give a BPE model's ids.)  Runs of marks have pieces of equal
rank, for which order matters; words that begin with several marks are merged
step by step.

Any model's pieces can also be taken as those of a unigram model (``kind``), its
scores as log-probabilities: then the segmentation of the greatest total is
found by the forward scores, of equal totals the one whose last pieces are longer.
The query encodes both ways.

Defined cases: null and empty texts have no ids; characters that the model
lacks become their bytes; the mark character itself is a blank to the model, so
it comes back as one, and all else comes back as it was.  Equal rows are
encoded each; other columns are ignored by ``encode``.
"""

from __future__ import annotations

import copy
import heapq
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import chunks, released, worker_cache

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: words kept with their ids in a worker
CACHE_WORDS = 400_000
#: bytes of text that are encoded at once, as fewer distinct words are looked up in longer stretches
STRETCH_BYTES = 4 << 20
#: pairs of pieces that a worker remembers
CACHE_PAIRS = 2_000_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f", raw[i : i + 4])[0] if n == 4 else raw[i : i + 8]
            i += n


class PieceModel:
    """Pieces of a SentencePiece model file with an identity normaliser."""

    def __init__(self, raw: bytes, as_kind: int | None = None):
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.byte_ids = np.full(256, -1, np.int64)
        self.kind, self.unknown, self.fallback, self.prefix = UNIGRAM, 0, False, True
        decoded: list[bytes] = []
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                text, kind = piece.get(1, b"").decode(), piece.get(3, _NORMAL)
                number = len(self.scores)
                self.scores.append(piece.get(2, 0.0))
                if kind == _BYTE:
                    self.byte_ids[int(text[3:5], 16)] = number
                    decoded.append(bytes([int(text[3:5], 16)]))
                elif kind in (_NORMAL, _USER):
                    self.ids[text] = number
                    decoded.append(text.replace(MARK, " ").encode())
                else:
                    self.unknown = number if kind == _UNKNOWN else self.unknown
                    decoded.append(b"")
            elif field == 2:
                spec = dict(_fields(value))
                self.kind, self.fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that leave the text as it is are supported")
                self.prefix = bool(spec.get(3, 1))
        self.kind = as_kind or self.kind
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"models of type {self.kind} are not supported")
        self._automaton()
        self.cuts = self._never_inside()
        self.floor = min((self.scores[k] for k in self.ids.values()), default=0.0) - 10.0
        self.widths = np.array([len(x) for x in decoded], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self._beside: dict[int, bool] = {}
        self._wholes: dict[int, bool] = {}
        self._text = {number: text for text, number in self.ids.items()}
        self._numbers = 1 + max(self._text, default=0)

    def _automaton(self) -> None:
        """States are prefixes of pieces; each lists the pieces that end there, the longest first."""
        self.step: list[dict[str, int]] = [{}]
        own: list[int] = [-1]
        for text, number in self.ids.items():
            at = 0
            for char in text:
                nxt = self.step[at].get(char)
                if nxt is None:
                    nxt = self.step[at][char] = len(self.step)
                    self.step.append({})
                    own.append(-1)
                at = nxt
            own[at] = number
        self.fail = [0] * len(own)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        level, depth = [0], 0
        while level:
            following = []
            for at in level:
                if at:
                    mine = ((own[at], depth),) if own[at] >= 0 else ()
                    self.ends[at] = mine + self.ends[self.fail[at]]
                for char, nxt in self.step[at].items():
                    if at:
                        back = self.fail[at]
                        while back and char not in self.step[back]:
                            back = self.fail[back]
                        self.fail[nxt] = self.step[back].get(char, 0)
                    following.append(nxt)
            level, depth = following, depth + 1
        self.jumps: list[dict[str, int]] = [dict(x) for x in self.step]

    def _jump(self, at: int, char: str) -> int:
        """The state after ``char``, by the fallback states; kept for the next time."""
        back = at
        while back and char not in self.step[back]:
            back = self.fail[back]
        nxt = self.step[back].get(char, 0)
        if char.isascii():
            self.jumps[at][char] = nxt
        return nxt

    def _never_inside(self) -> np.ndarray:
        """Pairs of ASCII bytes (first * 256 + second, a blank for the mark) that no piece holds side by side: words are cut there."""
        out = np.zeros((256, 256), bool)
        out[:128, :128] = True
        out[0x20, 0x20] = False
        for text in self.ids:
            raw = text.replace(MARK, " ").encode()
            for a, b in zip(raw, raw[1:], strict=False):
                out[a, b] = False
        out[0x20, :] = False  # a mark stays with what follows it
        return out.ravel()

    # a piece number below 0 is a character without a piece

    def merge(self, word: str) -> list[tuple[int, int, int]]:
        """Start, end and piece of a BPE encoding by merging the best-ranked, leftmost pair again and again."""
        n, get = len(word), self.ids.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (number := get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (-self.scores[number], a, b, end[b]))

        alive = [True] * n
        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if not (alive[a] and b < n and alive[b]) or end[a] != b or end[b] != stop:
                continue
            end[a], alive[b] = stop, False
            if stop < n:
                before[stop] = a
            offer(before[a], a)
            offer(a, stop)
        return [(k, end[k], get(word[k : end[k]], -1)) for k in range(n) if alive[k]]

    def beside(self, a: int, b: int) -> bool:
        """Whether merging leaves piece ``a`` before piece ``b`` as they are."""
        if a < 0 or b < 0:
            return True
        key = a * self._numbers + b
        known = self._beside.get(key)
        if known is None:
            known = [p for _, _, p in self.merge(self._text[a] + self._text[b])] == [a, b]
            if len(self._beside) > CACHE_PAIRS:
                self._beside.clear()
            self._beside[key] = known
        return known

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words, found in sorted order with the states of shared prefixes."""
        out: dict[str, list[int]] = {}
        unigram, scores, ends, jumps = self.kind == UNIGRAM, self.scores, self.ends, self.jumps
        known, beside, size = self._beside.get, self.beside, self._numbers
        last, back, best, state = [-1], [0], [0.0], [0]  # of each prefix: last piece, where it starts, score, automaton
        previous = ""
        for word in sorted(words):
            if not unigram and word.startswith(MARK + MARK):
                out[word] = self._ids(word, self.merge(word))
                continue
            n, shared = len(word), 0
            for a, b in zip(word, previous, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], back[shared + 1 :], best[shared + 1 :], state[shared + 1 :]
            at = state[-1]
            for j in range(shared + 1, n + 1):
                char = word[j - 1]
                nxt = jumps[at].get(char)
                at = self._jump(at, char) if nxt is None else nxt
                state.append(at)
                piece, start = -1, j - 1
                if unigram:
                    top = best[j - 1] + self.floor
                    for number, length in ends[at]:
                        if (value := best[j - length] + scores[number]) > top:
                            top, piece, start = value, number, j - length
                    best.append(top)
                else:
                    for number, length in ends[at]:
                        i = j - length
                        if i:
                            before = last[i]
                            ok = known(before * size + number)
                            if ok is None:
                                ok = beside(before, number)
                        else:
                            ok = j == 1 or self._whole(number)
                        if ok:
                            piece, start = number, i
                            break
                    best.append(0.0)
                last.append(piece)
                back.append(start)
            previous = word
            parts, j = [], n
            while j:
                parts.append((back[j], j, last[j]))
                j = back[j]
            out[word] = self._ids(word, parts[::-1])
        return out

    def _whole(self, number: int) -> bool:
        """Whether merging makes this piece of its own characters."""
        known = self._wholes.get(number)
        if known is None:
            known = self._wholes[number] = len(self.merge(self._text[number])) == 1
        return known

    def _ids(self, word: str, parts: list[tuple[int, int, int]]) -> list[int]:
        ids: list[int] = []
        for a, b, piece in parts:
            if piece >= 0:
                ids.append(piece)
            elif self.fallback:
                ids += self.byte_ids[list(word[a:b].encode())].tolist()
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts whose ids stand between the offsets ``at``, and their offsets.  Unknown ids give nothing."""
        width = self.widths[ids]
        upto = np.concatenate(([0], np.cumsum(width)))
        data = self.bytes[np.arange(upto[-1]) + np.repeat(self.starts[ids] - upto[:-1], width)]
        off = upto[at]
        if self.prefix:  # the mark before the text goes
            drop = off[:-1][np.diff(off) > 0]
            drop = drop[data[drop] == 0x20]
            gone = np.zeros(len(data) + 1, np.int64)
            gone[drop + 1] = 1
            off = off - np.cumsum(gone)[off]
            data = np.delete(data, drop)
        return data, off


class WordEncoder:
    """Ids of texts by models of the same pieces; each distinct word is encoded once while the cache holds it."""

    def __init__(self, *models: PieceModel):
        self.models, self.model = models, models[0]
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        # for each model the ids of all known words in a row, and where each word's begin
        self.held = [(np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)) for _ in self.models]

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words that were not known."""
        texts = [w.decode().replace(" ", MARK) for w in words]
        base = len(self.known)
        for k, model in enumerate(self.models):
            found = model.encode_words(texts)
            ids = [found[t] for t in texts]
            flat, at = self.held[k]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            total, used = int(lengths.sum()), int(at[-1])
            if used + total > len(flat):
                flat = np.concatenate([flat[:used], np.zeros(max(total, used), np.int32)])
            flat[used : used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.int32, total)
            self.held[k] = flat, np.concatenate([at, used + np.cumsum(lengths)])
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        return np.arange(base, base + len(words))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row by the first model, and their offsets."""
        return self.encode_all(data, off)[0]

    def encode_all(self, data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each model the ids of all documents in a row, and their offsets."""
        mark = MARK.encode()
        if (data == mark[0]).any() and mark in (raw := data.tobytes()):  # the mark itself is a blank
            parts = [raw[a:b].replace(mark, b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
            data, off = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        some = np.diff(off) > 0
        if not some.any():
            return [(np.zeros(0, np.int32), np.zeros(len(off), np.int64)) for _ in self.models]
        if self.model.prefix:
            data = np.insert(data, off[:-1][some], 0x20)
            off = off + np.concatenate(([0], np.cumsum(some)))
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.model.cuts[data[:-1].astype(np.int32) << 8 | data[1:]] | (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[off] = True
        cut[-1] = True
        at = np.flatnonzero(cut)
        words = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self._reset()
        find = self.known.get
        number = np.fromiter((find(w, -1) for w in distinct), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._learn([distinct[k] for k in new.tolist()])
        number = number[coded.indices.to_numpy()]
        of, out = np.searchsorted(at, off), []
        for flat, where in self.held:
            begin = where[number]
            lengths = where[number + 1] - begin
            upto = np.concatenate(([0], np.cumsum(lengths)))
            out.append((flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], lengths)], upto[of]))
        return out


_encoders: dict[tuple[str, tuple[int, ...]], WordEncoder] = worker_cache("piece_codec")


def word_encoder(model_file: str, *kinds: int) -> WordEncoder:
    """The encoder of a file, by its own kind of model or by the given ones (0: its own); only one is kept."""
    key = model_file, kinds
    if key not in _encoders:
        _encoders.clear()
        with open(model_file, "rb") as f:
            own = PieceModel(f.read())
        models = []
        for kind in kinds or (0,):  # the same pieces and automaton
            models.append(copy.copy(own))
            models[-1].kind = kind or own.kind
        _encoders[key] = WordEncoder(*models)
    return _encoders[key]


# -- operators ------------------------------------------------------------


def encode(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text", kind: int | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` of every row.  ``model_file`` is on every machine, as part of the installation; ``kind`` overrides its model type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(model_file, kind or 0)
        for batch in batches:
            for chunk in chunks(batch.column("text"), STRETCH_BYTES):
                ids, at = encoder.encode(chunk.data, chunk.off)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, len(chunk)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    id_kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(released(run, "piece_codec"), f"doc_id {id_kind}, ids array<int>")


def decode(coded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``; null ids give an empty text, bytes that are no UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_encoder(model_file, 0).model
        for batch in batches:
            column = batch.column("ids")
            lengths = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
            data, off = model.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(lengths))))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].decode(errors="replace") for a, b in zip(off[:-1], off[1:], strict=True)], pa.string())], ["doc_id", "text"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """Every row encoded, decoded again and compared, by the model's own kind and by the greatest total score.

    Returns ``doc_id, n_pieces, ids_crc32, n_bytes, restored`` for the first and
    ``n_viterbi, viterbi_crc32, viterbi_restored`` for the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(model_file, 0, UNIGRAM)
        for batch in batches:
            for chunk in chunks(batch.column("text"), STRETCH_BYTES):
                columns = []
                for ids, at in encoder.encode_all(chunk.data, chunk.off):
                    data, off = encoder.model.decode(ids, at)
                    little = ids.astype("<u4")
                    sums = [zlib.crc32(little[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                    if np.array_equal(off, chunk.off) and np.array_equal(data, chunk.data):
                        same = [True] * len(chunk)
                    else:
                        same = [np.array_equal(data[a:b], chunk.data[c:d]) for a, b, c, d in zip(off[:-1], off[1:], chunk.off[:-1], chunk.off[1:], strict=True)]
                    columns += [pa.array(np.diff(at)), pa.array(sums, pa.int64()), pa.array(np.diff(off)), pa.array(same)]
                del columns[6]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, len(chunk)), *columns],
                    ["doc_id", "n_pieces", "ids_crc32", "n_bytes", "restored", "n_viterbi", "viterbi_crc32", "viterbi_restored"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces long, ids_crc32 long, n_bytes long, restored boolean, n_viterbi long, viterbi_crc32 long, viterbi_restored boolean"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(released(run, "piece_codec"), schema)


def model_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_file())


QUERIES = {"op2_piece_codec": op2_piece_codec}
ORACLE_SQL: dict[str, str] = {}
