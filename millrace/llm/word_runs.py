"""Periodic runs of words, found on a grammar of the words.

A run is a stretch of words with smallest period q, of ``max(12, 2 q)`` words at least, that no neighbouring word extends. The word ids of a batch of documents
are compressed by Re-Pair: pairs of neighbouring symbols that occur again become nonterminals, in rounds in which every pair that occurs
more often than the pairs it overlaps is replaced wherever it stands, until none occurs twice. What is left of a document is
joined by rules that occur once, so that each document has one root. A run lies whole in the smallest nonterminal that
holds it, across the boundary of that one's two parts. So the runs across each nonterminal's boundary are computed once, on its first
occurrence; they are carried to all positions at which it is derived, and of those of a document with one period the maximal ones stay.

Which periods are tried at a boundary: q words apart from the boundary stand equal words, at least six in a row, so that one of four
groups of three words beside the boundary stands q words further on or before. How far a period reaches comes from a search on exact sums
of hashes in two prime fields. Documents in which no six words in a row occur twice hold no run and need no grammar.

Every document is worked on by one task without a shuffle. Defined results: null, empty and blank texts have no words and no run; repeated rows are
judged row by row; a null id counts as an empty string where an id is hashed; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import mix
from millrace.llm.tables import written

U = np.uint64
_PRIMES = (2147483647, 2147483629)
#: Equal words in a row, one period apart, that the shortest run holds.
_EQUAL = 6
_GRAM = 3
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


@dataclass(frozen=True)
class WordRuns:
    """``min_length`` (12 at least) and twice the period bound a run's length; ``planted`` makes the words of every tenth id periodic, to measure on."""

    min_length: int = 12
    planted: bool = False
    words_per_batch: int = 200_000
    words_kept: int = 500_000
    tried_at_once: int = 500_000
    rows_per_batch: int = 1000


def planted(words: list, doc_id: int | None) -> list:
    """The words of a document whose id's checksum ends in 0 repeat from a place on; others stay."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def grams(ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` ids from each place on, different between documents; those that reach beyond their document are unlike all others."""
    out = mix(owner.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    value = mix(ids.astype(U) + U(0x632BE59BD9B4E019))
    whole = np.zeros(len(ids), bool)
    if len(ids) >= n:
        places = len(ids) - n + 1
        for k in range(n):
            out[:places] = mix(out[:places] + value[k : k + places])
        whole[:places] = owner[:places] == owner[n - 1 :]
    out[~whole] = mix(np.flatnonzero(~whole).astype(U) | U(1 << 63))
    return out


def with_repeats(ids: np.ndarray, owner: np.ndarray, documents: int) -> np.ndarray:
    """Whether a document may hold a run: six of its words in a row occur again in it."""
    key = grams(ids, owner, _EQUAL)
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    out = np.zeros(documents, bool)
    out[owner[order[same]]] = True
    return out


class Reach:
    """How many words from two places on (or before them) are equal, by binary search on hashes of stretches."""

    def __init__(self, ids: np.ndarray) -> None:
        self.fields = []
        for k, p in enumerate(_PRIMES):
            base = 1_000_003 + 2 * k
            power = np.ones(len(ids) + 1, np.int64)
            done = 1
            while done < len(power):  # doubling
                more = min(done, len(power) - done)
                power[done : done + more] = power[:more] * pow(base, done, p) % p
                done += more
            value = (mix(ids.astype(U) + U(k + 1)) % U(p)).astype(np.int64)
            sums = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(value * power[:-1] % p, out=sums[1:])  # exact below 2^32 words
            self.fields.append((p, power, sums))

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether stretches of a size are equal; ``a`` stands before ``b``."""
        out = np.ones(len(a), bool)
        for p, power, sums in self.fields:
            left, right = (sums[a + size] - sums[a]) % p, (sums[b + size] - sums[b]) % p
            out &= left * power[b - a] % p == right
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The number of equal words from ``a`` and ``b`` on, or before them, up to ``most``."""
        low, high = np.zeros(len(a), np.int64), np.maximum(most, 0)
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                return low
            mid = (low[todo] + high[todo] + 1) // 2
            x, y = a[todo], b[todo]
            fits = self._equal(x - mid, y - mid, mid) if back else self._equal(x, y, mid)
            low[todo[fits]] = mid[fits]
            high[todo[~fits]] = mid[~fits] - 1


@dataclass
class Rules:
    """Nonterminals of one round with the word places at which they are derived: those of ``rule[i]`` begin at ``at[i]``, their second part at ``cut[i]``, and end at ``end[i]``."""

    rule: np.ndarray
    at: np.ndarray
    cut: np.ndarray
    end: np.ndarray


def grammar(ids: np.ndarray, owner: np.ndarray) -> Iterator[Rules]:
    """Re-Pair over all documents at once, round by round, and then the rules that join what is left of each."""
    symbol, at, doc = np.unique(ids, return_inverse=True)[1].astype(np.int64), np.arange(len(ids)), owner
    end = at + 1
    next_symbol = int(symbol.max(initial=-1)) + 1
    live = np.ones(max(0, len(symbol) - 1), bool)  # pairs that may occur twice
    while True:
        idx = np.flatnonzero(live & (doc[1:] == doc[:-1]))
        if not len(idx):
            break
        _, inverse, count = np.unique(symbol[idx] * next_symbol + symbol[idx + 1], return_inverse=True, return_counts=True)
        rank = np.zeros(len(symbol) + 1, np.int64)  # by count, then by pair; place i + 1 is pair i's
        often = count[inverse] > 1
        rank[idx[often] + 1] = (count[inverse] * len(count) + inverse)[often]
        middle = rank[1:-1]
        chosen = (middle > 0) & (middle >= rank[:-2]) & (middle >= rank[2:])
        if not chosen.any():
            break
        # Neighbours are chosen together only in a row of one pair, where every second one stays.
        places = np.flatnonzero(chosen)
        begins = np.concatenate(([True], np.diff(places) > 1))
        first = places[begins][np.cumsum(begins) - 1]
        places = places[(places - first) % 2 == 0]
        pair = np.full(len(symbol), -1, np.int64)
        pair[idx] = inverse
        names, rule = np.unique(pair[places], return_inverse=True)
        yield Rules(rule, at[places], at[places + 1], end[places + 1])
        symbol, end = symbol.copy(), end.copy()
        symbol[places], end[places] = next_symbol + rule, end[places + 1]
        next_symbol += len(names)
        kept = np.ones(len(symbol), bool)
        kept[places + 1] = False
        fresh = np.zeros(len(symbol), bool)
        fresh[places] = True
        repeated = np.zeros(len(symbol), bool)
        repeated[:-1] = rank[1:-1] > 0
        symbol, at, end, doc, fresh, repeated = (x[kept] for x in (symbol, at, end, doc, fresh, repeated))
        live = repeated[:-1] | fresh[:-1] | fresh[1:]
    while True:
        starts = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        place = np.arange(len(doc)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
        left = np.flatnonzero((place[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
        if not len(left):
            return
        yield Rules(np.arange(len(left)), at[left], at[left + 1], end[left + 1])
        end = end.copy()
        end[left] = end[left + 1]
        kept = np.ones(len(doc), bool)
        kept[left + 1] = False
        at, end, doc = (x[kept] for x in (at, end, doc))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from ``first`` up to ``last`` (exclusive) of every pair, with the pair's number."""
    n = np.maximum(last - first, 0)
    pair = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[pair], pair


class Boundaries:
    """Runs across the boundaries of nonterminals."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, how: WordRuns) -> None:
        self.how, self.size = how, len(ids)
        self.reach = Reach(ids)
        kind = np.unique(grams(ids, owner, _GRAM), return_inverse=True)[1].astype(np.int64)
        self.key = kind * (len(ids) + 1) + np.arange(len(ids))  # of a group's places, in order
        self.sorted = np.sort(self.key)

    def __call__(self, at: np.ndarray, cut: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(nonterminal, start, end, period)`` of the stretches across ``cut`` inside ``at .. end``."""
        every = np.arange(len(at))
        # The same three words as at a place before the boundary stand further on, or as at one behind it further back.
        tried = []
        for place, ahead in ((cut - _GRAM, True), (cut - 1, True), (cut, False), (cut - _GRAM + 1, False)):
            use = every[(place >= at) & (place + _GRAM <= end)]
            place = place[use]
            base = self.key[place] - place
            low, high = (place + 1, end[use] - _GRAM + 1) if ahead else (at[use], place)
            tried.append((use, place, np.full(len(use), ahead), *(np.searchsorted(self.sorted, base + x) for x in (low, high))))
        rule, place, ahead, first, last = (np.concatenate(x) for x in zip(*tried, strict=True))
        some = last > first
        rule, place, ahead, first, last = (x[some] for x in (rule, place, ahead, first, last))
        parts = (np.cumsum(last - first) - 1) // self.how.tried_at_once
        found = []
        for part in np.split(np.arange(len(rule)), np.flatnonzero(np.diff(parts)) + 1):
            where, k = _spread(first[part], last[part])
            k = part[k]
            q = np.abs(self.sorted[where] - self.key[place[k]])
            fits = 2 * q <= (end - at)[rule[k]]
            q, k = q[fits], k[fits]
            r = rule[k]
            x = np.where(ahead[k], cut[r], cut[r] - q)  # equal words are looked for around x and x + q
            inside = (x >= at[r]) & (x + q <= end[r])
            q, r, x = q[inside], r[inside], x[inside]
            begin = x - self.reach(x, x + q, x - at[r], back=True)
            stop = x + q + self.reach(x, x + q, end[r] - x - q)
            run = (stop - begin >= np.maximum(self.how.min_length, 2 * q)) & (begin < cut[r]) & (stop > cut[r])
            found.append(_smallest(r[run], begin[run], stop[run], q[run]))
        return _smallest(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _smallest(group: np.ndarray, begin: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of equal stretches the one with the smallest period: the others are its multiples."""
    order = np.lexsort((period, stop, begin, group))
    group, begin, stop, period = (x[order] for x in (group, begin, stop, period))
    first = np.ones(len(group), bool)
    first[1:] = (group[1:] != group[:-1]) | (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1])
    return tuple(x[first] for x in (group, begin, stop, period))


def _maximal(owner: np.ndarray, begin: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of a document and period that no other one holds; a run is always found whole, beside its parts."""
    order = np.lexsort((-stop, begin, period, owner))
    owner, begin, stop, period = (x[order] for x in (owner, begin, stop, period))
    starts = np.ones(len(owner), bool)
    starts[1:] = (owner[1:] != owner[:-1]) | (period[1:] != period[:-1])
    group = np.cumsum(starts)
    span = int(stop.max(initial=0)) + 1
    upto = np.maximum.accumulate(stop + group * span) - group * span  # the furthest end so far in the group
    kept = starts.copy()
    kept[1:] |= stop[1:] > upto[:-1]
    return tuple(x[kept] for x in (owner, begin, stop, period))


def runs(ids: np.ndarray, owner: np.ndarray, how: WordRuns = WordRuns()) -> tuple[np.ndarray, ...]:
    """``(document, start, end, period)`` of all runs, by places in the batch; ``owner`` numbers the documents in ascending order."""
    rounds, seen = [], 0
    for rules in grammar(ids, owner):
        wide = rules.end - rules.at >= how.min_length
        rounds.append((rules.rule[wide] + seen, rules.at[wide], rules.cut[wide], rules.end[wide]))
        seen += int(rules.rule.max(initial=-1)) + 1
    if not seen:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    rule, at, cut, end = (np.concatenate(x) for x in zip(*rounds, strict=True))
    order = np.argsort(rule, kind="stable")
    rule, at, cut, end = (x[order] for x in (rule, at, cut, end))
    names, first = np.unique(rule, return_index=True)
    r, begin, stop, period = Boundaries(ids, owner, how)(at[first], cut[first], end[first])
    # To every place at which the nonterminal is derived.
    where, pair = _spread(first[r], np.append(first, len(rule))[r + 1])
    shift = at[where] - at[first][r[pair]]
    begin, stop, period = begin[pair] + shift, stop[pair] + shift, period[pair]
    return _smallest(*_maximal(owner[begin], begin, stop, period))


class _Numbers(dict):
    """A number for each word, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _row(doc: list, words: list, begin: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple:
    """One document's result from its runs in order."""
    length = stop - begin
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, begin + period, 1)
    np.add.at(drop, stop, -1)
    gone = np.cumsum(drop[:-1]) > 0
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(begin.tolist(), length.tolist(), period.tolist(), strict=True))
    best = (None,) * 4
    if len(begin):
        k = int(np.lexsort((period, begin, -length))[0])
        best = (int(begin[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k]))
        words = compress(words, (~gone).tolist())
    return (doc, len(begin), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), len(gone), int(gone.sum()))


def _worker(how: WordRuns) -> Callable:
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
    none = np.zeros(0, np.int64)

    number = _Numbers()

    def solve(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        if len(number) > how.words_kept:
            number.clear()
        sizes = np.array([len(w) for _, w in held], np.int64)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(w for _, w in held)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(held)), sizes)
        some = with_repeats(ids, owner, len(held)) if len(ids) else np.zeros(len(held), bool)
        picked = some[owner]
        doc, begin, stop, period = runs(ids[picked], owner[picked], how)
        first = np.concatenate(([0], np.cumsum(np.where(some, sizes, 0))))[:-1]
        bounds = np.searchsorted(doc, np.arange(len(held) + 1))
        rows = []
        for i, (name, words) in enumerate(held):
            a, b = bounds[i], bounds[i + 1]
            rows.append(_row(name, words, begin[a:b] - first[i], stop[a:b] - first[i], period[a:b]) if b > a else _row(name, words, none, none, none))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for i in range(batch.num_rows):
                doc = batch.column(0)[i].as_py()
                words = (batch.column(1)[i].as_py() or b"").split()  # bytes are split at ASCII white space only
                words = planted(words, doc) if how.planted else words
                held.append((doc, words))
                n += len(words)
                if n >= how.words_per_batch:
                    yield solve(held)
                    held, n = [], 0
            if held:
                yield solve(held)

    return work


def report(docs: DataFrame, how: WordRuns = WordRuns()) -> DataFrame:
    """One row per document: number of runs, the longest one, digests of all runs and of the words that are left without repeats."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return written(rows.mapInArrow(_worker(how), SCHEMA), "word-runs", rows=how.rows_per_batch)
