"""Rounds of comparison: no link is lost where pairs are left out at first, and no round is run for nothing."""

import numpy as np
import pytest

from millrace.llm import line_dedup, links
from millrace.llm.hashing import U


def _families(count: int, steps: int) -> list[str]:
    """Lines in chains: neighbours are alike, the ends of a chain are not."""
    rng, out = np.random.default_rng(8), []
    for _ in range(count):
        line = rng.integers(97, 123, 220)
        for _ in range(steps):
            out.append("".join(map(chr, line)))
            line = line.copy()
            line[rng.choice(np.arange(5, 215), 3, replace=False)] = rng.integers(65, 91, 3) + 32
    return out


def _labels(lines: list[str]) -> dict[str, str]:
    """The first line of each line's component, by exact comparison of all pairs."""
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for k in range(i):
            if label[i] != label[k] and 100 * len(sets[i] & sets[k]) >= 75 * len(sets[i] | sets[k]):
                old, new = max(label[i], label[k]), min(label[i], label[k])
                label = [new if x == old else x for x in label]
    return {x: lines[label[i]] for i, x in enumerate(lines)}


@pytest.mark.parametrize(("nearest", "broadcast_rows"), [(4, 300_000), (1, 300_000), (1, 0)])
def test_components_with_pairs_left_out_and_lines_not_broadcast(spark, monkeypatch, nearest, broadcast_rows):
    monkeypatch.setattr(links, "NEAREST", nearest)
    lines = _families(12, 9)
    labels = _labels(lines)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "node long, line string")
    got = {r.node: r.label for r in line_dedup._resolved(df, line_dedup.LineDedup(broadcast_rows=broadcast_rows)).collect()}
    assert len(set(labels.values())) < len(lines)
    assert {x: lines[got.get(i, i)] for i, x in enumerate(lines)} == labels


def test_the_last_round_is_only_for_groups_of_which_pairs_were_left_out(spark, monkeypatch):
    """One group of several components: nothing is left out with 100 pairs a node, so that there is one round."""
    calls, real = [], links._across
    monkeypatch.setattr(links, "_across", lambda *a: calls.append(real(*a)) or calls[-1])
    sets = {i: np.arange(i * 1000, i * 1000 + 60, dtype=np.uint64) * U(0x9E3779B97F4A7C15) for i in range(6)}
    near = {10 + i: np.append(s[1:], U(5)) for i, s in sets.items()}
    rows = [(i, len(s), links.sketch(np.sort(s)), np.sort(s).tobytes()) for i, s in (sets | near).items()]
    sketches = spark.createDataFrame([(i, n, bytearray(k), bytearray(e)) for i, n, k, e in rows], "node long, n long, sketch binary, elements binary")
    groups = links.written(spark.createDataFrame([(1, 0, [*range(1, 6), *range(10, 16)], 1)], links.GROUPS_SCHEMA), "groups")
    fetch = lambda nodes: sketches.join(nodes, "node", "left_semi").select("node", "elements")
    got = {r.node: r.label for r in links.resolve(groups, sketches.select("node", "n", "sketch"), fetch, 75).collect()}
    assert got == {i: i % 10 for i in [*sets, *near]} and len(calls) == 1
