"""Components of similar sets: candidate groups by key, sketches that rule pairs out, exact checks, union-find.

A *node* is a distinct set of hashes. Map tasks pack a node's join keys into binary columns, dealt by key into buckets; a reduce
task sorts the keys of its buckets and gives the groups of nodes that share a key. Similar nodes share a key, so links lie
inside groups. Groups are never expanded into all pairs:

1. every node is checked against the group's first node with which it shares most keys;
2. then against the first nodes of its other groups that are not yet in its component;
3. in groups that still span several components, all pairs across components that sketches don't rule out are checked, in blocks.

So no link between different components is lost, and what agrees already is not compared again. Groups travel as pieces of bounded
length, blocks bound a task's members, and components are found by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import U, mix
from millrace.llm.tables import discard, written

KEYS_SCHEMA = "bucket int, nodes binary, sizes binary, marks binary, counts binary, keys binary"
GROUPS_SCHEMA = "gid long, pivot long, members array<long>, weight int"
AsSet = Callable[[bytes], np.ndarray]
#: Groups up to this size are cut by marks.
SPLIT = 256
#: Rows of texts or sets in a batch for Python.
ROWS = 1000
#: Members in one piece of a group.
PIECE = 4096
#: Pairs per node and cell in the rounds before the last, and how many of these rounds there are at most.
NEAREST, ROUNDS = 4, 1
#: Members in one side of a block of pairs, and about how many bytes of sketches a cell of small groups holds.
BLOCK, CELL_BYTES = 1500, 8_000_000
#: Members that groups with the same first one bring to one cell.
CELL_ROWS = 400_000


def size_class(n: np.ndarray) -> np.ndarray:
    """Sizes as powers of 1.05, at most 255."""
    return np.minimum(np.log(np.maximum(n, 1)) / np.log(1.05), 255).astype(np.uint8)


def key_rows(nodes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A batch's keys by bucket: per bucket the nodes that have keys there, the classes of their sizes, how many keys each, and the keys.

    ``keys`` holds the first node's ``counts[0]`` keys, then the second's, and so on. High bits of a key choose the bucket, the low 32 stand for it there:
    keys that agree by chance stay as rare as a bucket is small, and what they bring together is checked.
    """
    owner = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
    bucket = (keys >> U(40)) % U(buckets)
    order, cuts = _dealt(bucket)
    keys, owner, bucket = keys.astype(np.uint32)[order], owner[order], bucket[order]
    classes, out = size_class(sizes), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        firsts = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
        here = owner[a:b][firsts]
        out.append((int(bucket[a]), nodes[here].tobytes(), classes[here].tobytes(), b"", np.diff(firsts, append=b - a).astype(np.uint32).tobytes(), keys[a:b].tobytes()))
    return _keys_batch(out)


def band_rows(nodes: np.ndarray, marks: np.ndarray, keys: np.ndarray, parts: int) -> pa.RecordBatch:
    """``key_rows`` for nodes that have one key in each of some bands (the columns of ``keys``), with 64 bits of MinHash as marks. A band has ``parts`` buckets of its own."""
    bucket = (np.arange(keys.shape[1], dtype=U) * U(parts) + (keys >> U(40)) % U(parts)).T.ravel()
    order, cuts = _dealt(bucket)
    owner, flat, bucket, out = order % max(1, len(nodes)), keys.astype(np.uint32).T.ravel()[order], bucket[order], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out.append((int(bucket[a]), nodes[owner[a:b]].tobytes(), b"", marks[owner[a:b]].tobytes(), b"", flat[a:b].tobytes()))
    return _keys_batch(out)


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order by bucket, and where each bucket begins in it (and the last ends)."""
    bucket = bucket.astype(np.uint16 if not len(bucket) or bucket.max() < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, [*np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1)).tolist(), len(bucket)]


def _keys_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(columns)], [c.split(" ")[0] for c in KEYS_SCHEMA.split(", ")])


def _plausible(marks: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the members that marks connect; members that differ in more than ``most`` bits are not connected directly."""
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= most
    label = np.arange(len(marks))
    while True:
        least = np.where(near, label[None, :], len(marks)).min(1)
        if (least == label).all():
            return [np.flatnonzero(label == k) for k in np.unique(label)]
        label = least


def _group_bucket(bucket: int, nodes: np.ndarray, sizes: np.ndarray, marks: np.ndarray, keys: np.ndarray, apart: int, most: int) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """``(gid, pivot, members, weight)`` for keys that two nodes or more share; groups of the same members count once.

    A group is cut where the sizes of neighbours in the order of size are too far apart for any pair across the cut, and where marks differ too much for similar sets.
    """
    order = np.argsort((keys.astype(U) << U(8)) | sizes)
    sizes, keys = sizes[order].astype(np.int16), keys[order]
    edge = np.ones(len(keys), bool)
    edge[1:] = (keys[1:] != keys[:-1]) | (sizes[1:] - sizes[:-1] > apart)
    # Only what shares a key goes on; tasks that met the same node gave it the same keys.
    group = np.cumsum(edge)
    shared = np.flatnonzero(~edge | ~np.append(edge[1:], True))
    order, group, sizes, keys = order[shared], group[shared], sizes[shared], keys[shared]
    nodes, marks = nodes[order], marks[order] if len(marks) else None
    order = np.lexsort((nodes, group))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (group[order][1:] != group[order][:-1]) | (nodes[order][1:] != nodes[order][:-1])
    order = order[fresh]
    nodes, group, sizes, keys, marks = nodes[order], group[order], sizes[order], keys[order], marks[order] if marks is not None else None
    starts = np.flatnonzero(np.diff(group, prepend=0))
    long = np.diff(starts, append=len(keys))
    shared = long > 1
    if marks is not None:
        pairs = np.flatnonzero(long == 2)
        shared[pairs[np.bitwise_count(marks[starts[pairs]] ^ marks[starts[pairs] + 1]) > most]] = False
    starts, long = starts[shared], long[shared]
    if not len(starts):
        return
    inside = np.repeat(long > 0, long)
    begins = np.concatenate(([0], np.cumsum(long)[:-1]))
    at = np.repeat(starts - begins, long) + np.arange(len(inside))
    digest = np.add.reduceat(mix(nodes[at].astype(U)), begins)
    _, first, weight = np.unique(mix(digest + long.astype(U)), return_index=True, return_counts=True)
    gids = mix((keys[starts].astype(U) | (sizes[starts].astype(U) << U(32))) + mix(np.array([bucket], U)))
    for i, w in zip(first.tolist(), weight.tolist(), strict=True):
        members = nodes[starts[i] : starts[i] + long[i]]
        parts = [members] if marks is None or not 2 < len(members) <= SPLIT else [members[k] for k in _plausible(marks[starts[i] : starts[i] + long[i]], most)]
        for k, part in enumerate(parts):
            if len(part) > 1:
                yield int((gids[i] + U(k)).view(np.int64)), int(part[0]), part[1:], w


def grouped(rows: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Groups of nodes that share a key, from ``key_rows``; a task holds one bucket at a time."""
    apart = int(np.log(100 / percent) / np.log(1.05)) + 1
    # Marks of sets with this similarity differ in each bit by half of what they lack; so many standard deviations are one pair in a million.
    differ = (100 - percent) / 200
    most = int(64 * differ + 5.5 * (64 * differ * (1 - differ)) ** 0.5)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, [[], [], [], []]

        def groups() -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for gid, pivot, members, weight in _group_bucket(bucket, *map(np.concatenate, held), apart, most):
                # No piece has a single member unless the group has: ``_across`` knows pairs by that.
                out += [(gid, pivot, part, weight) for part in np.array_split(members, -(-len(members) // PIECE))]
                size += len(members)
                if size >= 200_000:
                    yield _groups_batch(out)
                    out, size = [], 0
            yield _groups_batch(out)

        for batch in batches:
            for b, n, s, m, c, k in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if b != bucket and held[0]:
                    yield from groups()
                    held = [[], [], [], []]
                bucket, n, k = b, np.frombuffer(n, np.int64), np.frombuffer(k, np.uint32)
                c = np.frombuffer(c, np.uint32) if c else 1
                s = np.frombuffer(s, np.uint8) if s else np.zeros(len(n), np.uint8)
                for part, x in zip(held, (np.repeat(n, c), np.repeat(s, c), np.repeat(np.frombuffer(m, U), c) if m else np.zeros(0, U), k), strict=True):
                    part.append(x)
        if held[0]:
            yield from groups()

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, GROUPS_SCHEMA)


def _groups_batch(rows: list[tuple[int, int, np.ndarray, int]]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
    members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), members, pa.array([r[3] for r in rows], pa.int32())], ["gid", "pivot", "members", "weight"])


def stored_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, U)


def sketch(distinct: np.ndarray) -> bytes:
    """Parity bits of a set: each hash flips one bit. Sets of different sizes compare by folding the longer sketch."""
    size = 1 << max(6, int(len(distinct)).bit_length() + 2)
    bits = np.bitwise_and(np.bincount((mix(distinct ^ U(0x1D8E4E27C47D124F)) % U(size)).astype(np.int64), minlength=size), 1)
    return np.packbits(bits.astype(np.uint8)).tobytes()


#: Low bits of a hash that make room for the number of a set in ``distinct``.
_SETS = U(21)


def distinct(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set and hash of the different elements of fewer than 2 ** 21 sets, told apart by their hashes' high bits.

    ``hashes`` holds the sets one after the other, beginning at ``firsts``, with repeats.
    """
    owner = np.repeat(np.arange(len(firsts), dtype=U), np.diff(firsts, append=len(hashes)))
    both = np.sort((owner << (U(64) - _SETS)) | (hashes >> _SETS))
    both = both[np.diff(both, prepend=~both[:1]) != 0]
    return (both >> (U(64) - _SETS)).astype(np.int64), both << _SETS


def outlines(owner: np.ndarray, hashes: np.ndarray, sets: int) -> tuple[np.ndarray, pa.Array]:
    """Sizes and parity sketches of what ``distinct`` gave."""
    n = np.bincount(owner, minlength=sets)
    size = 1 << (np.maximum(6, np.frexp(n)[1] + 2)).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(size)))
    place = mix(hashes ^ U(0x1D8E4E27C47D124F)) & (size[owner] - 1).astype(U)
    flat = np.packbits((np.bincount(base[owner] + place.astype(np.int64), minlength=base[-1]) & 1).astype(np.uint8))
    return n, pa.Array.from_buffers(pa.binary(), sets, [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(flat)])


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements that only one of the sets has."""
    x, y = _unpacked(a), _unpacked(b)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())


def allowed(n: int, m: int, percent: int) -> int:
    """Elements that only one of two sets of these sizes may have at this similarity."""
    return (100 - percent) * (n + m) // (100 + percent)


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of ``(a, b)``, the pairs that sizes and sketches don't rule out."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = pa.array([apart(s, t) <= allowed(x, y, percent) for x, y, s, t in zip(na, nb, sa, sb, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    side = lambda k, *more: sketches.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), *(F.col(c).alias(f"{c}_{k}") for c in more))
    sized = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    both = sized.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b").select("a", "b", "na", "nb", "sketch_a", "sketch_b")
    return written(both.mapInArrow(near, "a long, b long"), "near", rows=ROWS)


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Which of at most 4096 pairs of sets are similar: ``a`` and ``b`` hold hashes, with repeats, and where each set begins. 52 bits tell elements of a pair apart."""
    sides = []
    for hashes, firsts in (a, b):
        owner = np.repeat(np.arange(len(firsts), dtype=U), np.diff(firsts, append=len(hashes)))
        both = np.sort((owner << U(52)) | (hashes >> U(12)))
        sides.append(both[np.diff(both, prepend=~both[:1]) != 0])
    count = lambda x: np.bincount((x >> U(52)).astype(np.int64), minlength=len(a[1]))
    every = np.sort(np.concatenate(sides))
    both = count(every[:-1][every[1:] == every[:-1]])
    return 100 * both >= percent * (count(sides[0]) + count(sides[1]) - both)


def _each(batch: pa.RecordBatch, percent: int, as_set: AsSet) -> list[bool]:
    keep = []
    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        x, y = as_set(x), as_set(y)
        both = len(np.intersect1d(x, y, assume_unique=True))
        keep.append(100 * both >= percent * (len(x) + len(y) - both))
    return keep


def _similar(pairs: DataFrame, sets: DataFrame, percent: int, as_set: AsSet, many: Callable | None = None) -> DataFrame:
    """Of ``(a, b)``, the pairs whose sets are similar, with the stored ``sets`` of their nodes; ``many`` makes the hashes of a column of sets at once."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            keep = pa.array(alike(many(batch.column(2)), many(batch.column(3)), percent) if many else _each(batch, percent, as_set), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    side = lambda k: sets.select(F.col("node").alias(k), F.col("elements").alias(f"elements_{k}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "elements_a", "elements_b")
    return written(rows.mapInArrow(similar, "a long, b long"), "links", rows=ROWS)


def _nodes(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's edges, one from each node to the least one that it is connected with in the batch."""
    for batch in batches:
        nodes, ends = np.unique(np.concatenate((batch.column(0).to_numpy(), batch.column(1).to_numpy())), return_inverse=True)
        u, v = ends[: batch.num_rows], ends[batch.num_rows :]
        label = np.arange(len(nodes))
        while True:
            before = label.copy()
            np.minimum.at(label, label[u], label[v])
            np.minimum.at(label, label[v], label[u])
            label = label[label]
            if (label == before).all():
                break
        other = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the least node of each component, by rounds of large and small stars over the forests of batches of edges."""
    edges = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_forest, "u long, v long"), "edges")
    state = lambda e: e.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        older, edges = edges, written(small, "edges")
        discard(older)
        after = state(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    labels = written(stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct()), "labels")
    discard(edges)
    return labels


def _labelled(pairs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    side = labels.select(F.col("node").alias(column), F.col("label").alias(f"l{column}"))
    return pairs.join(side, column, "left").withColumn(f"l{column}", F.coalesce(f"l{column}", column))


def _closest(node: np.ndarray, n: np.ndarray, raw: list[bytes], a: np.ndarray, b: np.ndarray, percent: int, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of places ``a, b``, those that sketches don't rule out; with ``nearest`` so many per ``a``, and the nodes ``a`` of which some are left out."""
    lengths = np.array([len(r) for r in raw])
    size = np.minimum(lengths[a], lengths[b])
    distance = np.zeros(len(a), np.int64)
    for s in np.unique(size).tolist():
        pairs = np.flatnonzero(size == s)
        used, place = np.unique(np.concatenate([a[pairs], b[pairs]]), return_inverse=True)
        bits = np.stack([_fold(_unpacked(raw[i]), s) for i in used.tolist()])
        if s % 8 == 0:
            bits = bits.view(U)
        x, y = place[: len(pairs)], place[len(pairs) :]
        step = max(1, (1 << 22) // s)
        for i in range(0, len(pairs), step):
            distance[pairs[i : i + step]] = np.bitwise_count(bits[x[i : i + step]] ^ bits[y[i : i + step]]).sum(1, dtype=np.int64)
    close = distance <= (100 - percent) * (n[a] + n[b]) // (100 + percent)
    a, b, distance = a[close], b[close], distance[close]
    cut = a[:0]
    if nearest:
        order = np.lexsort((distance, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        rank = np.arange(len(a)) - np.repeat(first, np.diff(first, append=len(a)))
        cut = np.unique(a[rank == nearest])
        a, b = a[rank < nearest], b[rank < nearest]
    return node[a], node[b], node[cut]


def _shared_pairs(runs: list[np.ndarray], left: np.ndarray, right: np.ndarray, allow: Callable) -> np.ndarray:
    """Codes ``a * len(left) + b`` of the pairs of places that share a run and that ``allow`` lets pass, each once.

    ``runs`` holds places in ``left`` and ``right``, two flags of each place: pairs go from a left one to a right one.
    """
    n, spread = len(left), sum(len(r) ** 2 for r in runs)
    used = np.unique(np.concatenate(runs))
    if len(runs) * len(used) ** 2 < 50 * spread:  # much the same members: which pairs meet anywhere is a product of matrices
        inside = np.zeros((len(runs), len(used)), np.float32)
        for i, r in enumerate(runs):
            inside[i, np.searchsorted(used, r)] = 1
        x, y = np.nonzero(allow(used[:, None], used[None, :]) & ((inside * left[used]).T @ (inside * right[used]) > 0))
        return used[x] * n + used[y]
    out = []
    for r in runs:
        x, y = np.nonzero(allow(r[:, None], r[None, :]) & left[r][:, None] & right[r][None, :])
        out.append(r[x] * n + r[y])
    return np.unique(np.concatenate(out))


def _across(groups: DataFrame, labels: DataFrame, sketches: DataFrame, done: DataFrame, percent: int, nearest: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of nodes that are not ``done``, as a written table: those of different components that share a group and that sketches don't rule out; with ``nearest`` so many per node and cell.
    Beside it the ``gid`` of groups of which pairs are left out so, if there are any: components only grow, so that no other group can bring a pair that was not compared.

    A cell holds many small groups, or pairs of blocks of large ones; both are bounded. Groups with the same first member in the order of a
    hash meet in a cell: sets that are alike share hundreds of groups of nearly the same members, and each pair is compared there once.
    """
    groups = groups.filter(F.size("members") > 1)  # a group of two is its star, which has been checked
    rows = groups.select("gid", F.explode(F.concat(F.array("pivot"), F.col("members"))).alias("node")).distinct()
    rows = _labelled(rows, labels, "node")
    mixed = rows.groupBy("gid").agg(F.min("lnode").alias("x"), F.max("lnode").alias("y"), F.count(F.lit(1)).alias("m"), F.min(F.xxhash64("node")).alias("rep")).filter("x != y and m > 2").select("gid", "m", "rep")
    mixed = written(mixed, "mixed")
    total = mixed.agg(F.sum("m")).first()[0]
    if not total:
        discard(mixed)
        return written(groups.sparkSession.createDataFrame([], "a long, b long"), "rest"), None
    length = sketches.agg(F.avg(F.length("sketch"))).first()[0]
    cells = int(total * (length + 100) / CELL_BYTES) + 1
    held = mixed.groupBy("rep").agg(F.sum("m").alias("held"))
    part = F.pmod(F.xxhash64("gid"), (F.col("held") / CELL_ROWS).cast("int") + 1)
    blocks = F.pow(2, F.ceil(F.log2(F.greatest(F.col("m") / BLOCK, F.lit(1.0))))).cast("int")
    dealt = mixed.join(held, "rep").select("gid", "rep", part.alias("part"), blocks.alias("blocks"))
    rows = rows.join(dealt, "gid").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Each block meets every block once: the row goes to the pairs (i, j) and (j, i) with the lower first.
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("p", F.least("i", "j")).withColumn("q", F.greatest("i", "j"))
    cell = F.when(F.col("blocks") > 1, F.xxhash64("rep", "part", "blocks", "p", "q")).otherwise(F.pmod(F.xxhash64("rep", "part"), F.lit(cells)))
    rows = written(rows.select(cell.alias("cell"), "rep", "gid", "p", "q", "i", "node", "lnode"), "cells")
    again = groups.sparkSession.read.schema(rows.schema).parquet(rows.table_path)  # columns of its own
    nodes = again.select("cell", "node", "lnode", "p", "q", "i").distinct().join(sketches, "node")

    def compared(key: tuple, members: pa.Table, nodes: pa.Table) -> pa.Table:
        members = members.sort_by([("rep", "ascending"), ("gid", "ascending"), ("node", "ascending")])
        rep, gid, node = (members.column(c).to_numpy() for c in ("rep", "gid", "node"))
        distinct, first = np.unique(nodes.column("node").to_numpy(), return_index=True)
        label, n, p, q, side = (nodes.column(c).to_numpy()[first] for c in ("lnode", "n", "p", "q", "i"))
        raw = nodes.column("sketch").take(pa.array(first)).to_pylist()
        place = np.searchsorted(distinct, node)
        within = p == q
        allow = lambda a, b: (label[a] != label[b]) & ((a < b) | ~within[a]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        cuts = [*np.flatnonzero(np.diff(gid, prepend=gid[0] ^ 1)).tolist(), len(gid)]
        runs, found, out, held = [], [], [], 0
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            runs.append(place[s:e])
            if e == len(gid) or rep[e] != rep[s]:
                found.append(_shared_pairs(runs, side == p, side == q, allow))
                held, runs = held + len(found[-1]), []
            if found and (e == len(gid) or held > 1_000_000):
                a, b = np.divmod(np.unique(np.concatenate(found)), len(distinct))
                out.append(_closest(distinct, n, raw, a, b, percent, nearest))
                found, held = [], 0
        a, b, cut = (np.concatenate([o[k] for o in out]) for k in (0, 1, 2))
        pairs = pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})
        return pa.concat_tables([pairs, pa.table({"a": pa.array(cut, pa.int64()), "b": pa.nulls(len(cut), pa.int64())})])

    pairs = rows.groupBy("cell").cogroup(nodes.groupBy("cell")).applyInArrow(compared, "a long, b long").distinct()
    if not nearest:
        out = written(pairs.join(done, ["a", "b"], "left_anti"), "rest")
        discard(mixed, rows)
        return out, None
    pairs = written(pairs, "pairs")
    out = written(pairs.filter("b is not null").join(done, ["a", "b"], "left_anti"), "rest")
    cut = written(again.join(pairs.filter("b is null").select(F.col("a").alias("node")), "node", "left_semi").select("gid").distinct(), "cut")
    discard(mixed, rows, pairs)
    return out, None if cut.isEmpty() else cut


def resolve(groups: DataFrame, sketches: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, as_set: AsSet = stored_set, many: Callable | None = None, at_once: bool = False) -> DataFrame:
    """``(node, label)`` of the nodes that have links.

    ``sketches`` has ``node, n, sketch`` of all nodes in groups. ``fetch`` gives ``node, elements`` of the nodes that it is asked for: those of
    pairs that sketches leave open; ``as_set`` makes the sorted distinct hashes of ``elements``, ``many`` those of a column (``alike``). With ``at_once`` steps 1 and 2 are one: for nodes of few keys,
    that saves more than leaving out pairs that agree already.
    """
    stars = groups.select("pivot", "weight", F.explode("members").alias("node")).groupBy("pivot", "node").agg(F.sum("weight").alias("w"))
    stars = written(stars.select(F.col("pivot").alias("a"), F.col("node").alias("b"), "w"), "stars")
    near = _near(stars, sketches, percent)
    nodes = _nodes(near)
    sets = written(fetch(nodes), "sets", compression="none", rows=ROWS)
    discard(nodes)
    kept = [near]  # tables that later rounds read
    if at_once:
        links = _similar(near, sets, percent, as_set, many)
        kept.append(links)
        discard(sets)
    else:
        best = near.join(stars, ["a", "b"]).groupBy("b").agg(F.max_by("a", F.struct("w", -F.col("a"))).alias("a")).select("a", "b")
        best = written(best, "best")
        first = _similar(best, sets, percent, as_set, many)
        labels = components(first)
        open_ = _labelled(_labelled(near, labels, "a"), labels, "b").filter("la != lb").select("a", "b").join(best, ["a", "b"], "left_anti")
        second = _similar(open_, sets, percent, as_set, many)
        links = first.unionByName(second)
        kept += [first, second]
        discard(sets, best, labels)
    labels = components(links)
    discard(stars)
    # Nearest pairs first: what they join need not be compared pair by pair. The last round leaves nothing out, and is for groups of which the one before it left pairs out.
    done, rounds = near, [NEAREST] * ROUNDS + [0]
    while rounds:
        nearest = rounds.pop(0)
        rest, cut = _across(groups, labels, sketches, done, percent, nearest)
        kept.append(rest)
        if cut is None:
            rounds = []
        else:
            groups = groups.join(cut, "gid", "left_semi")
            kept.append(cut)
        if rest.isEmpty():
            rounds = rounds[-1:]
            continue
        nodes = _nodes(rest)
        sets = written(fetch(nodes), "sets", compression="none", rows=ROWS)
        more = _similar(rest, sets, percent, as_set, many)
        discard(sets, nodes)
        kept.append(more)
        if more.isEmpty():
            rounds = rounds[-1:]
        else:
            links, done = links.unionByName(more), done.unionByName(rest)
            discard(labels)
            labels = components(links)
    discard(*kept)
    return labels
