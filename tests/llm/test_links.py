"""Packed keys, marks and exact checks of the similarity joins, without Spark."""

import numpy as np

from millrace.llm import line_dedup, links
from millrace.llm.hashing import U, character_shingles, quick_shingles


def unpacked(batch):
    out = set()
    for bucket, nodes, _, _, counts, keys in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
        nodes, keys = np.frombuffer(nodes, np.int64), np.frombuffer(keys, np.uint32)
        counts = np.frombuffer(counts, np.uint32) if counts else 1
        out |= {(bucket, n, k) for n, k in zip(np.repeat(nodes, counts).tolist(), keys.tolist(), strict=True)}
    return out


def test_many_keys_of_one_node():
    """More keys of a node in one bucket than 16 bits can count."""
    keys = np.random.default_rng(1).integers(0, 1 << 64, 200_003, np.uint64)
    got = unpacked(links.key_rows(np.array([5, 9]), np.array([200_000, 3]), np.array([200_000, 3]), keys, 2))
    low, bucket = (keys & U(0xFFFFFFFF)).tolist(), ((keys >> U(40)) % U(2)).tolist()
    assert got == {(b, 5 if i < 200_000 else 9, k) for i, (b, k) in enumerate(zip(bucket, low, strict=True))}


def test_band_rows():
    keys = np.random.default_rng(2).integers(0, 1 << 64, (50, 7), np.uint64)
    got = unpacked(links.band_rows(np.arange(50) + 100, np.zeros(50, U), keys, 3))
    assert got == {(7 * 0 + 3 * j + int(keys[i, j] >> U(40)) % 3, 100 + i, int(keys[i, j] & U(0xFFFFFFFF))) for i in range(50) for j in range(7)}


def test_nothing():
    assert links.key_rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), 4).num_rows == 0
    assert links.band_rows(np.zeros(0, np.int64), np.zeros(0, U), np.zeros((0, 3), U), 4).num_rows == 0


def test_groups_against_brute_force():
    rng = np.random.default_rng(3)
    nodes, keys = rng.integers(0, 200, 3000), rng.integers(0, 900, 3000).astype(np.uint32)
    sizes = links.size_class(10 + nodes % 7 * 40)
    got = {}
    for gid, pivot, members, weight in links._group_bucket(1, nodes, sizes, np.zeros(0, U), keys, 6, 0):
        assert gid not in got
        got[gid] = (frozenset([pivot, *members.tolist()]), weight)
    want = {}
    for k in np.unique(keys):
        by = sorted({(int(s), int(n)) for s, n in zip(sizes[keys == k], nodes[keys == k], strict=True)})
        cut = [i for i in range(1, len(by)) if by[i][0] - by[i - 1][0] > 6]
        for a, b in zip([0, *cut], [*cut, len(by)], strict=True):
            if b - a > 1:
                members = frozenset(n for _, n in by[a:b])
                want[members] = want.get(members, 0) + 1
    assert dict(got.values()) == want


def test_marks_keep_similar_pairs():
    """Pairs at exactly 0.75 stay; unlike pairs mostly go."""
    rng, kept, gone = np.random.default_rng(4), 0, 0
    for _ in range(2000):
        shared, a, b = rng.integers(0, 1 << 64, 60, np.uint64), *rng.integers(0, 1 << 64, (2, 10), np.uint64)
        m = line_dedup.marks(line_dedup.signatures(np.concatenate((shared, a, shared, b)), np.array([0, 70]), line_dedup.LineDedup()))
        kept += len(links._plausible(m, 22)) == 1
        m = line_dedup.marks(line_dedup.signatures(rng.integers(0, 1 << 64, 140, np.uint64), np.array([0, 70]), line_dedup.LineDedup()))
        gone += len(links._plausible(m, 22)) == 2
    assert kept == 2000 and gone > 1900


def test_exact_checks():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 60, rng.integers(1, 90), np.uint64) * U(0x9E3779B97F4A7C15) for _ in range(400)]
    column = lambda s: (np.concatenate(s), np.cumsum([0, *map(len, s)])[:-1])
    got = links.alike(column(sets[:200]), column(sets[200:]), 75)
    pairs = [(set(a.tolist()), set(b.tolist())) for a, b in zip(sets[:200], sets[200:], strict=True)]
    assert got.tolist() == [100 * len(a & b) >= 75 * len(a | b) for a, b in pairs]
    n, sketches = links.outlines(*links.distinct(*column(sets)), 400)
    assert n.tolist() == [len(set(s.tolist())) for s in sets]
    raw = sketches.to_pylist()
    assert all(links.apart(raw[i], raw[200 + i]) <= len(a ^ b) for i, (a, b) in enumerate(pairs))


def test_quick_shingles():
    """Equal shingles have equal hashes, others don't, wherever they stand; texts of every length."""
    import random

    draw, seen = random.Random(8), {}
    texts = ["".join(draw.choice("abcäß漢😀 ") for _ in range(draw.randrange(1, 30))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    hashes, firsts = quick_shingles(data, at, 5)
    assert firsts.tolist() == character_shingles(data, at, 5)[1].tolist()
    for t, a, b in zip(texts, firsts.tolist(), [*firsts[1:].tolist(), len(hashes)], strict=True):
        shingles = [t[i : i + 5] for i in range(max(1, len(t) - 4))]
        assert b - a == len(shingles)
        for x, h in zip(shingles, hashes[a:b].tolist(), strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) >= len(seen) - 1
