"""N-gram Jaccard join by PartEnum signatures.

A text's set holds the hashes of its distinct word n-grams.  Set sizes are cut
into bands whose ends differ by the similarity at most, so linked sets lie in
the same or in neighbouring bands and differ in at most ``k`` n-grams, ``k``
being fixed by the band.  For each band the domain of n-grams is partitioned by
a hash, partitions into sub-partitions, and every subset of sub-partitions that
``k`` differences must leave untouched somewhere gives one signature: the hash
of the set's part in it.  Linked sets share a signature.  Parts of few n-grams
or none are no keys; a set that has more of them than the partition allows for
also gives the signatures of a second partition, and so on, so none are lost.

Equal sets are one node from the start.  The nodes of a signature are a group of
candidates; groups of the same nodes are one.  A group travels with parity
sketches (a lower bound of the difference of two sets, about a fiftieth of the
sets' bytes), and its nodes are compared by them; only pairs that the sketches
can't part are links.  The links' components are then compared exactly: sizes
first, wide sketches next, the sets last.  So sets travel for near copies alone,
and texts that merely share a passage meet by sketch in the groups of their
signatures.  Groups of more than ``GROUP_NODES`` nodes are cut into pairs of blocks.

In components of more than ``BLOCK_NODES`` nodes (or their weight in n-grams) all
sets are compared with a few pivots first, which links near copies of one text
in one pass.  Such components are cut into overlapping size bands, as linked sets
lie in neighbouring ones.  Nodes of a band that the pivots linked need no
comparison with each other, so each of them goes to one block and the rest to
all; only where the rest is large are blocks compared in pairs.

Defined cases: a text without words, null included, has an empty set and is
linked with nothing; a text with fewer words than an n-gram has one n-gram, the
whole sequence; equal ids are separate rows of one document; a null id takes
part in links and is not a component's name unless it is alone (then null);
other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .textcore import LOWER, NOT_SPACE, Chunk, bit_filter, chunks, combine, discard, in_filter, mix, released, rolling_prefix, span_hash, written

#: nodes of one signature that are compared in one place
GROUP_NODES = 4_096
#: nodes of a component that one task compares; so many n-grams weigh as much as a node
BLOCK_NODES, NODE_GRAMS = 16_384, 512
#: nodes of a larger component that all others are compared with first, and bytes of all their sets
PIVOTS, PIVOT_BYTES = 32, 64 << 20
#: signatures that a task gathers before it sends them on
TASK_SIGNATURES = 1 << 20
LEVELS = 4
SKETCH_WORDS = 32
_U = np.uint64


def shingles(chunk: Chunk, n: int) -> list[np.ndarray]:
    """The sorted set of word n-gram hashes of each document."""
    starts, ends, at = chunk.words(NOT_SPACE)
    low = LOWER[chunk.data]
    hashes = span_hash(rolling_prefix(low), starts, ends, low)
    grams = combine([hashes[k : len(hashes) - n + 1 + k] for k in range(n)]) if len(hashes) >= n else hashes[:0]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(combine([hashes[k : k + 1] for k in range(a, b)], seed=b - a))
        else:
            out.append(hashes[:0])
    return out


def node_of(grams: np.ndarray) -> int:
    """64-bit identity of a set, as a signed long."""
    return int(mix(np.array([mix(grams).sum(dtype=_U) + _U(len(grams))], _U)).view(np.int64)[0])


# -- signatures -----------------------------------------------------------


@lru_cache(maxsize=64)
def bands(percent: int, upto: int) -> tuple[tuple[int, int], ...]:
    """(first size, last size) of consecutive bands that reach size ``upto`` and one band beyond."""
    out, low = [], 1
    while True:
        high = max(low, 100 * low // percent)
        out.append((low, high))
        if low > upto:
            return tuple(out)
        low = high + 1


@lru_cache(maxsize=4096)
def scheme(percent: int, low: int, high: int) -> tuple[int, int, tuple[tuple[int, ...], ...], int, int]:
    """For sets of ``low`` to ``high`` n-grams: partitions, sub-partitions, subsets of them, weak parts allowed for, least n-grams of a part.

    Parts with fewer n-grams are weak: unlike sets share them too often.  With
    so many parts more than ``k + 1``, linked sets share that many more; unless
    a set has more weak parts than that, one of the shared ones is not weak.
    """
    k = 2 * high * (100 - percent) // (100 + percent)
    if k <= 2:  # one partition; any k of the k + 2 sub-partitions may differ
        parts = 1 if k == 0 else k + 2
        return 1, parts, tuple(itertools.combinations(range(parts), parts - k)), 0, 1
    spare = 2 + k // 6
    outer = -(-(k + 1 + spare) // 2)
    mean = low / (2 * outer)
    least, weak, term = 1, 0.0, math.exp(-mean)
    for n in range(4):  # the most n-grams a part may need for half the spare parts to be weak on average
        weak += term
        term *= mean / (n + 1)
        if 2 * outer * weak > spare / 2:
            break
        least = n + 1
    return outer, 2, ((0,), (1,)), 2 * outer - k - 1, least


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets in a row, and the number of the set of each."""
    sizes = np.array([len(s) for s in sets], np.int64)
    edges = bands(percent, int(sizes.max(initial=1)))
    lows = np.array([low for low, _ in edges])
    out, owner = [], []
    work = [(k, b + step, 0) for k, b in zip(np.flatnonzero(sizes).tolist(), (np.searchsorted(lows, sizes[sizes > 0], "right") - 1).tolist(), strict=True) for step in (0, 1)]
    while work:
        flat = np.concatenate([sets[k] for k, _, _ in work])
        length = np.array([len(sets[k]) for k, _, _ in work])
        schemes = [scheme(percent, edges[max(0, b - 1)][0], edges[b][1]) for _, b, _ in work]
        seed = combine([np.array([b for _, b, _ in work], _U), np.array([level for _, _, level in work], _U)])
        spread = mix(flat ^ np.repeat(seed, length))
        outer = np.array([s[0] for s in schemes], _U)
        inner = np.array([s[1] for s in schemes], _U)
        cell = ((spread >> _U(32)) * np.repeat(outer, length) >> _U(32)) * np.repeat(inner, length) + ((spread & _U(0xFFFFFFFF)) * np.repeat(inner, length) >> _U(32))
        cells = (outer * inner).astype(np.int64)
        base = np.cumsum(cells) - cells
        cell = cell.astype(np.int64) + np.repeat(base, length)
        total = int(cells.sum())
        count = np.bincount(cell, minlength=total)
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        sums = np.zeros(total, _U)
        sums[cell[order][first]] = np.add.reduceat(mix(flat)[order], first)
        again = []
        simple = np.array([s[1] == 2 for s in schemes])
        if simple.any():  # each sub-partition is a signature of its own
            of = np.repeat(np.arange(len(work)), cells)
            use = simple[of] & (count >= np.array([s[4] for s in schemes])[of])
            at = np.flatnonzero(use)
            out.append(combine([sums[at], seed[of[at]], (at - base[of[at]]).astype(_U)]))
            owner.append(np.array([k for k, _, _ in work])[of[at]])
        for w in range(len(work)):
            k, b, level = work[w]
            _, _, subsets, spare, least = schemes[w]
            mine = slice(base[w], base[w] + cells[w])
            if simple[w]:
                weak = np.flatnonzero(count[mine] < least)
                lost = len(weak) > spare
                if lost and level == LEVELS - 1:
                    out.append(combine([sums[mine][weak], np.full(len(weak), seed[w]), weak.astype(_U)]))
                    owner.append(np.full(len(weak), k))
            else:
                lost = False
                for number, subset in enumerate(subsets):
                    parts = np.array(subset) + base[w]
                    full = count[parts].sum() > 0
                    lost |= not full
                    if full or level == LEVELS - 1:
                        out.append(combine([sums[parts].sum(dtype=_U)[None], seed[w : w + 1], np.array([number], _U)], seed=7))
                        owner.append(np.array([k]))
            if lost and level < LEVELS - 1:
                again.append((k, b, level + 1))
        work = again
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


# -- candidate groups -----------------------------------------------------

_PART = "shard int, signatures binary, index binary, nodes binary"


def _planes(values: np.ndarray) -> bytes:
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def _unplaned(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _distinct(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs by signature, then node."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    return sig[new], node[new]


def _met(sig: list[np.ndarray], node: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose signature occurs more than once, by signature; most occur once and aren't sorted further.  Empties the lists, as whole shards weigh much."""
    found = np.concatenate(sig)
    sig.clear()
    order = np.argsort(found)
    found = found[order]
    again = np.zeros(len(found), bool)
    again[1:] = found[1:] == found[:-1]
    again[:-1] |= again[1:]
    found, order = found[again], order[again]
    nodes = np.concatenate(node)
    node.clear()
    return found, nodes[order]


def _signature_task(n: int, percent: int, shards: int):
    """The signatures of all sets, each with its nodes, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            sig, node = _distinct(np.concatenate([s for s, _ in held]), np.concatenate([x for _, x in held]))
            held.clear()
            edges = np.arange(1, shards, dtype=np.uint64) << _U(64 - shards.bit_length() + 1)
            cut = np.concatenate(([0], np.searchsorted(sig, edges), [len(sig)]))
            for s in range(shards):
                part = slice(cut[s], cut[s + 1])
                if cut[s] < cut[s + 1]:
                    names, index = np.unique(node[part], return_inverse=True)
                    blobs = (_planes(np.diff(sig[part], prepend=_U(0))), _planes(index.astype(np.uint32)), names.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], ["shard", "signatures", "index", "nodes"])

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                sets = shingles(chunk, n)
                nodes = np.array([node_of(s) for s in sets], np.int64)
                _, one = np.unique(nodes, return_index=True)
                sig, owner = signatures([sets[k] for k in one], percent)
                held.append((sig, nodes[one][owner]))
                size += len(sig)
                if size > TASK_SIGNATURES:
                    yield from sent()
                    size = 0
        if held:
            yield from sent()

    return run


def _group_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shards to ``group, nodes``: each set of two or more nodes that share a signature, once a task, large ones as pairs of blocks."""
    sig, node = [], []
    for batch in batches:
        for k in range(len(batch)):  # one row's blobs are Python objects at a time
            deltas, index, names = (batch.column(c)[k].as_py() for c in ("signatures", "index", "nodes"))
            sig.append(np.cumsum(_unplaned(deltas, _U), dtype=_U))
            node.append(np.frombuffer(names, np.int64)[_unplaned(index, np.uint32)])
    if not sig:
        return
    found, nodes = _met(sig, node)
    if not len(found):
        return
    found, nodes = _distinct(found, nodes)
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    end = np.append(first[1:], len(found))
    name = np.add.reduceat(mix(nodes.view(_U)), first)
    several = np.flatnonzero(end - first > 1)
    _, one = np.unique(name[several], return_index=True)
    several = several[one]
    small = several[(end - first)[several] <= GROUP_NODES]
    for k in range(0, len(small), 4096):
        own = small[k : k + 4096]
        size = (end - first)[own]
        at = np.arange(size.sum()) + np.repeat(first[own] - (np.cumsum(size) - size), size)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(nodes[at]))
        yield pa.RecordBatch.from_arrays([pa.array(name[own].view(np.int64)), lists], ["group", "nodes"])
    for k in several[(end - first)[several] > GROUP_NODES]:
        blocks = np.array_split(nodes[first[k] : end[k]], -(-2 * (end[k] - first[k]) // GROUP_NODES))
        for i, j in itertools.combinations(range(len(blocks)), 2):
            own = combine([np.array([x], _U) for x in (name[k], i, j)])
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array([np.concatenate([blocks[i], blocks[j]])], pa.list_(pa.int64()))], ["group", "nodes"])


# -- sketches -------------------------------------------------------------


def _sketch(grams: np.ndarray, width: int = SKETCH_WORDS) -> np.ndarray:
    """Parities of the set's members in 64 * ``width`` cells: two sketches differ in no more cells than the sets do."""
    odd = np.bincount((mix(grams) % _U(64 * width)).astype(np.int64), minlength=64 * width) & 1
    return np.packbits(odd.astype(bool)).view(_U)


def sketch_words(size: int, percent: int) -> int:
    """Words of a travelling sketch: a few cells for each difference that a set of that size is allowed."""
    cells = 6 * 2 * size * (100 - percent) // (100 + percent)
    return 1 << max(1, (-(-cells // 64) - 1).bit_length())


def near(sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that size and sketch can't part."""
    width = min(map(len, sketches))
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    table = np.array([np.bitwise_xor.reduce(sketches[k].reshape(-1, width), axis=0) for k in order])  # halves folded onto each other make a smaller sketch
    low, high = -(-percent * sizes // 100), 100 * sizes // percent
    out, rest = [], np.arange(len(order))
    while len(rest) > 1:
        work, rest = [int(rest[0])], rest[1:]
        while work and len(rest):
            x = work.pop()
            a, b = np.searchsorted(sizes[rest], [low[x], high[x] + 1])
            if a == b:
                continue
            own = rest[a:b]
            apart = np.bitwise_count(table[own] ^ table[x]).sum(axis=1, dtype=np.int64)
            hit = apart <= (sizes[own] + sizes[x]) * (100 - percent) // (100 + percent)
            if hit.any():
                found = own[hit].tolist()
                out += [(int(order[x]), int(order[y])) for y in found]
                work += found
                rest = np.concatenate([rest[:a], own[~hit], rest[b:]])
    return out


def _near_task(percent: int):
    """Rows of (group, node, n, sketch), all of a group in one partition and together, to links of nodes that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sizes, sketches = None, [], [], []
        a: list[int] = []
        b: list[int] = []

        def done() -> None:
            for x, y in near(np.array(sizes, np.int64), sketches, percent):
                a.append(nodes[x])
                b.append(nodes[y])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("group", "node", "n", "sketch"))
            for g, node, size, sketch in zip(*columns, strict=True):
                if g != group:
                    if len(nodes) > 1:
                        done()
                    group, nodes, sizes, sketches = g, [], [], []
                nodes.append(node)
                sizes.append(size)
                sketches.append(np.frombuffer(sketch, _U))
            if len(a) > 1 << 16:
                pairs = np.unique(np.column_stack([a, b]), axis=0)
                a, b = [], []
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        if len(nodes) > 1:
            done()
        if a:
            pairs = np.unique(np.column_stack([a, b]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


# -- exact comparison -----------------------------------------------------


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def cluster(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of the first set (by size) of its component.  Sets are distinct; equal numbers in ``known`` are components already."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order])
    group = np.arange(len(order))
    if known is not None:
        _, first, inverse = np.unique(known[order], return_index=True, return_inverse=True)
        group = first[inverse]
    lows = np.searchsorted(sizes, -(-percent * sizes // 100))
    most = 2 * sizes * (100 - percent) // (100 + percent)
    # sketches have a few cells for each difference that is allowed; wide sets need wide ones
    width = 1 << np.ceil(np.log2(np.maximum(3 * most, 128) / 64)).astype(np.int64)
    at, coarse, fine = 0, np.zeros((0, 1), _U), np.zeros((0, 1), _U)
    for x in range(1, len(order)):
        low = lows[x]
        if (group[low:x] == group[x]).all():
            continue
        if coarse.shape[1] != width[x]:
            at, end = low, int(np.searchsorted(width, width[x], "right"))
            fine = np.array([_sketch(sets[k], 8 * width[x]) for k in order[at:end]])
            coarse = np.bitwise_xor.reduce(fine.reshape(len(fine), 8, width[x]), axis=1)  # parts folded onto each other make a smaller sketch
        rivals = low + np.flatnonzero(np.bitwise_count(coarse[low - at : x - at] ^ coarse[x - at]).sum(axis=1, dtype=np.int64) <= most[x])
        rivals = rivals[group[rivals] != group[x]]
        apart = np.bitwise_count(fine[rivals - at] ^ fine[x - at]).sum(axis=1, dtype=np.int64)
        near = apart <= (sizes[rivals] + sizes[x]) * (100 - percent) // (100 + percent)
        rivals = rivals[near][np.argsort(apart[near], kind="stable")]
        while len(rivals):
            y = rivals[0]
            if linked(sets[order[x]], sets[order[y]], percent):
                to, old = sorted((group[x], group[y]))
                group[group == old] = to
                rivals = rivals[1:][group[rivals[1:]] != group[x]]
            else:
                rivals = rivals[1:]
    out = np.empty(len(order), np.int64)
    out[order] = order[group]
    return out


def _set_task(n: int, shared):
    """``node, grams`` of the sets whose node is in the filter, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                names, blobs = [], []
                sets = [s for s in shingles(chunk, n) if len(s)]
                nodes = np.array([node_of(s) for s in sets], np.int64)
                wanted = in_filter(shared.value, nodes)
                for node, grams, hit in zip(nodes.tolist(), sets, wanted.tolist(), strict=True):
                    if hit and node not in sent:
                        if len(sent) > 1 << 20:
                            sent.clear()
                        sent.add(node)
                        names.append(node)
                        blobs.append(grams.tobytes())
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["node", "grams"])

    return run


def _cluster_task(percent: int):
    """Rows of (part, node, label, grams), all of a part in one partition and together; nodes of one label are linked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            names = sorted(held)
            if len(names) > 1:
                at = cluster([held[x][1] for x in names], percent, np.array([held[x][0] for x in names], np.int64))
                own = np.array(names, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own[at])], ["a", "b"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "node", "label", "grams"))
            for p, node, label, grams in zip(*columns, strict=True):
                if p != part:
                    yield from done()
                    part, held = p, {}
                held[node] = label, np.frombuffer(grams, _U)
        yield from done()

    return run


def _pivot_task(n: int, percent: int, shared):
    """Links of every set to the pivots that it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = [(name, np.frombuffer(raw, _U)) for name, raw in shared.value]
        sizes = np.array([len(g) for _, g in pivots])
        sketches = np.array([_sketch(g) for _, g in pivots]).reshape(-1, SKETCH_WORDS)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                a, b = [], []
                for grams in shingles(chunk, n):
                    near = np.flatnonzero((sizes * 100 >= percent * len(grams)) & (len(grams) * 100 >= percent * sizes)) if len(grams) else ()
                    if not len(near):
                        continue
                    apart = np.bitwise_count(sketches[near] ^ _sketch(grams)).sum(axis=1, dtype=np.int64)
                    hit = [pivots[k][0] for k in near[apart <= (sizes[near] + len(grams)) * (100 - percent) // (100 + percent)] if linked(grams, pivots[k][1], percent)]
                    a += hit
                    b += [node_of(grams)] * len(hit)
                if a:
                    pairs = np.unique(np.column_stack([a, b]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _labels(text: DataFrame, groups: DataFrame, size: DataFrame, n: int, percent: int) -> DataFrame:
    """``node, label`` of nodes of large groups that are linked with a pivot: the same label for linked nodes.

    A few nodes of each large group are its pivots, so a large group of near
    copies is mostly linked in one pass, without comparing its nodes in pairs.
    The pivots' sets are broadcast up to ``PIVOT_BYTES``; that only saves work.
    """
    spark = text.sparkSession
    chosen = groups.join(size, "component").where(F.pmod(F.xxhash64("node"), F.col("m")) < PIVOTS).select("node")
    bits = spark.sparkContext.broadcast(bit_filter(chosen, "node"))
    found = text.mapInArrow(released(_set_task(n, bits)), "node long, grams binary").join(chosen, "node").groupBy("node").agg(F.first("grams").alias("grams"))
    kept, total = [], 0
    for row in found.toLocalIterator():
        if total + len(row.grams) > PIVOT_BYTES:
            break
        kept.append((row.node, bytes(row.grams)))
        total += len(row.grams)
    if not kept:
        return spark.createDataFrame([], "node long, label long")
    shared = spark.sparkContext.broadcast(kept)
    links = text.mapInArrow(released(_pivot_task(n, percent, shared)), "a long, b long")
    return components(links).withColumnRenamed("component", "label")


def _placed(text: DataFrame, groups: DataFrame, sizes: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """``node, part, label``: where each candidate is compared; and the links that are known by then, if a group was cut into parts."""
    weight = F.greatest(F.count("*"), F.floor(F.sum("n") / NODE_GRAMS))
    size = groups.join(sizes, "node").groupBy("component").agg(weight.alias("m")).where(F.col("m") > BLOCK_NODES)
    if size.isEmpty():
        return groups.select("node", F.col("component").alias("part"), F.col("node").alias("label")), None
    labels = written(text.sparkSession, _labels(text, groups, size, n, percent), "labels")  # kept until the session's folder goes: links are read from it
    joined = groups.join(size, "component", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = joined.where("m IS NULL").select("node", F.col("component").alias("part"), "label")
    # bands are four similarities wide; a set near a band's end could be linked with one in the next band, and goes there as well
    apart = math.log(100 / percent) * 1.0001
    band = F.floor(F.log("n") / (4 * apart))
    near = F.when(F.log("n") >= 4 * apart * (band + 1) - apart, F.array(band, band + 1)).otherwise(F.array(band))
    banded = joined.where("m IS NOT NULL").join(sizes, "node").select("node", "label", "component", "n", F.explode(near).alias("band"))
    # nodes of a band's most frequent label need no comparison with each other: each is in one block, the rest in all
    by_label = banded.groupBy("component", "band", "label").agg(weight.alias("c"))
    full = by_label.groupBy("component", "band").agg(F.sum("c").alias("m"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("main"))
    rest = F.col("m") - F.col("most")
    main_blocks = F.greatest(F.ceil(F.col("most") / BLOCK_NODES), F.lit(1))
    placed = banded.join(full.withColumns({"few": rest <= BLOCK_NODES, "blocks": F.when(rest <= BLOCK_NODES, main_blocks).otherwise(F.ceil(F.col("m") / BLOCK_NODES))}), ["component", "band"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    one = F.when(F.col("label") == F.col("main"), F.array(block)).otherwise(every)
    to = lambda x, y: F.xxhash64("component", "band", x, y)
    parts = F.when(F.col("few"), F.transform(one, lambda j: to(j, j))).otherwise(F.transform(every, lambda j: to(F.least(j, block), F.greatest(j, block))))
    cut = placed.select("node", F.explode(F.array_distinct(parts)).alias("part"), "label")
    return whole.unionByName(cut), labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def _components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """``doc_id, print, n_shingles, name`` of every row, and the tables it is read from: ``print`` hashes the text, ``name`` is the least (id is null, id, print) of the row's component."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    docs = docs.select("doc_id", F.xxhash64(text).alias("print"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = 1 << max(0, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                sets = shingles(chunk, n)
                sizes = [len(s) for s in sets]
                nodes = [node_of(s) if len(s) else None for s in sets]
                sketches = [_sketch(s, sketch_words(len(s), percent)).tobytes() if len(s) else None for s in sets]
                own = [batch.column(c).slice(chunk.first, len(chunk)) for c in ("doc_id", "print")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "print", "n_shingles", "node", "sketch"])

    rows = written(spark, docs.mapInArrow(released(describe), f"doc_id {kind}, print long, n_shingles long, node long, sketch binary"), "sets")
    some = rows.where("node IS NOT NULL")
    text = docs.select("text")
    parts = text.mapInArrow(released(_signature_task(n, percent, shards)), _PART).repartition(shards, "shard")
    same = parts.mapInArrow(released(_group_task), "group long, nodes array<long>").dropDuplicates(["group"])
    sketches = some.select("node", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["node"])
    met = same.select("group", F.explode("nodes").alias("node")).join(sketches, "node").repartition("group").sortWithinPartitions("group")
    near_ones = components(met.select("group", "node", "n", "sketch").mapInArrow(released(_near_task(percent)), "a long, b long"))
    groups = written(spark, near_ones, "candidates")
    discard(near_ones)

    sizes = some.groupBy("node").agg(F.first("n_shingles").alias("n"))
    placed, known = _placed(text, groups, sizes, n, percent)
    shared = spark.sparkContext.broadcast(bit_filter(groups, "node"))
    sets = text.mapInArrow(released(_set_task(n, shared)), "node long, grams binary")
    placed = sets.join(placed, "node").select("part", "node", "label", "grams").repartition("part").sortWithinPartitions("part")
    found = placed.mapInArrow(released(_cluster_task(percent)), "a long, b long")
    same = found.select(F.col("a").alias("node"), F.col("b").alias("component")) if known is None else components(found.unionByName(known))

    # every set's least row, then every component's
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    least = some.groupBy("node").agg(F.min(row).alias("least"))
    named = least.join(same, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(spark, named, "members")
    discard(groups, *([] if known is None else [same]))
    name = named.groupBy("component").agg(F.min("least").alias("name"))
    names = named.join(name, "component").select("node", "name")
    alone = rows.where("node IS NULL").select("doc_id", "print", "n_shingles", row.alias("name"))
    return some.join(names, "node").select("doc_id", "print", "n_shingles", "name").unionByName(alone), [rows, named]


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: components of texts whose n-gram sets have that Jaccard similarity in per cent."""
    return _components(docs, n, percent)[0].select("doc_id", "n_shingles", F.col("name.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those of documents that are not the least of their component.

    Rows are told apart by id and text.  Of repeated rows (equal id and text)
    with words any one stays; rows without words all stay.
    """
    spark = docs.sparkSession
    mark = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of ``docs``
    own_id, own_print = f"{mark}id", f"{mark}print"
    rows, tables = _components(docs, n, percent)
    found = rows.where("n_shingles > 0").groupBy("doc_id", "print", "name").agg(F.count("*").alias("times"))
    first = F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("print") == F.col("name.print"))
    found = written(spark, found.select(F.col("doc_id").alias(own_id), F.col("print").alias(own_print), first.alias("first"), "times"), "verdicts")
    discard(*tables)
    own = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own_print))
    kept = docs.join(found.where("NOT first").select(own_id, own_print), own, "left_anti")
    twice = found.where("first AND times > 1").select(own_id, own_print)
    if twice.isEmpty():
        return kept
    again = kept.join(twice, own).dropDuplicates([own_id, own_print]).drop(own_id, own_print)
    return kept.join(twice, own, "left_anti").unionByName(again)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g
  FROM words WHERE w IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT a, a FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(r.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) r USING (doc_id)
"""

QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLE_SQL = {"op8_jaccard_join": _SQL}
