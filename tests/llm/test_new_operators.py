"""Decontamination, resampling and word runs against plain Python: whole smallest tables, made cases, and tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import decontamination, resampling, word_runs
from millrace.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORDS = re.compile("[^ \t-\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item string, rank long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return ALNUM.findall(lowered(text))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and very long texts, ties and repeated rows, null ids, and columns with names that the operators use."""
    rng = random.Random(3)
    long = " ".join(f"W{rng.randrange(5000)}" for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two, THREE"), (5, long), (6, long), (6, long), (None, "a b c " * 20), (None, None), (7, "Äpfel ÄPFEL äpfel Été é1"), (8, "x " * 4000), (9, "p q r s t u v w x y z " * 3), (9, "p q r s t u v w x y z " * 3)]
    return [(i, t) for i, t in rows], spark.createDataFrame([(i, t, None, "s", None, "clash", 1) for i, t in rows], SCHEMA)


def leaks(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = alnum(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, named = alnum(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    named |= found
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def columns(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


LEAKS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_odd_rows(spark, odd):
    rows, docs = odd
    long = rows[4][1].split()
    items = [(1, " ".join(long[100:130])), (10, " ".join(long[120:131]).lower()), (2, None), (3, "!!"), (None, "q r"), (None, "äpfel"), (5, "p q r s t u v w x y z p q"), (6, "not anywhere at all"), (2, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for how in (decontamination.Decontamination(), decontamination.Decontamination(broadcast_rows=0), decontamination.Decontamination(lists=1)):
        assert columns(decontamination.report(docs, bench, how), LEAKS) == leaks(rows, items)
    clean = decontamination.clean(docs, bench).select("doc_id", "text", "item").collect()
    assert sorted((r.doc_id, r.text) for r in clean if r.doc_id) == sorted((r[0], r[1]) for r, x in zip(rows, (leaks([r], items)[0] for r in rows), strict=True) if not x[5] and r[0])
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.report(docs, nothing).collect())
    assert decontamination.report(docs.filter("false"), bench).count() == 0


def test_decontamination_proximity(spark):
    docs = [(1, "alpha x x beta x gamma"), (2, "gamma beta alpha"), (3, "alpha x x x x x x beta gamma"), (4, "alpha beta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    how = decontamination.Decontamination()
    found = decontamination.near(decontamination.Index(frame), decontamination.Windows(bench, how), 6, how)
    assert sorted((r.item, r.doc_id, r["first"], r["last"]) for r in found.collect()) == [("7", 1, 0, 5), ("7", 2, 0, 2)]


def test_decontamination_hot_passage(spark):
    """A passage in a third of all rows, and one very frequent word as an item of its own."""
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(i, f"the w{i} the " + (passage if i % 3 == 0 else "the")) for i in range(600)]
    items = [(1, passage), (2, "the")]
    assert columns(decontamination.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")), LEAKS) == leaks(docs, items)


def drawn(docs, bench, buckets=10_000):
    def features(text):
        w = alnum(text)
        return len(w), [zlib.crc32(x.encode()) % buckets for x in (*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))]

    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(x for *_, f in made for x in f), Counter(x for _, text in bench for x in features(text)[1])
    alls, allt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (alls + buckets) / ((s[k] + 1) * (allt + buckets)))) for k in range(buckets)]
    out = []
    for i, n, f in made:
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[5] = k
    return sorted((tuple(r[k] for k in (0, 1, 2, 3, 5)) for r in out), key=repr)


def test_resampling_table(spark):
    docs, bench = ([(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/{t}.parquet").collect()] for t in ("documents", "benchmark"))
    assert columns(QUERIES["op12_resampling"](spark, DATA), ("doc_id", "n_features", "weight", "score", "rank")) == drawn(docs, bench)


def test_resampling_odd_rows(spark, odd):
    rows, docs = odd
    names = ("doc_id", "n_features", "weight", "score", "rank")
    bench = [(1, "a b c and p q r"), (2, None)]
    for how in (resampling.Resampling(), resampling.Resampling(batch_bytes=10, words_kept=1, span=2, broadcast_rows=0)):
        assert columns(resampling.report(docs, spark.createDataFrame(bench, "item_id long, text string"), how), names) == drawn(rows, bench)
    assert resampling.report(docs.filter("false"), spark.createDataFrame(bench, "item_id long, text string")).count() == 0
    kept = resampling.resampled(docs, spark.createDataFrame([], "item_id long, text string"))
    assert kept.columns == docs.columns and kept.count() >= 1


def test_resampling_words_of_any_length():
    """Checksums of runs are carried on also over words longer than the table."""
    how, rng = resampling.Resampling(ngram=3, buckets=1 << 30), random.Random(5)
    texts = [" ".join(rng.choice("aé7") * rng.choice((1, 2, 61, 62, 63, 64, 65, 300)) for _ in range(rng.randrange(9))) for _ in range(60)]
    words, runs = resampling.BatchFeatures(how)([t.encode() for t in texts])
    got = sorted((int(i), int(b)) for owner, buckets in runs for i, b in zip(owner, buckets, strict=True))
    split = [t.split() for t in texts]
    assert words.tolist() == [len(w) for w in split]
    assert got == sorted((i, zlib.crc32(" ".join(w[k : k + n]).encode()) % (1 << 30)) for i, w in enumerate(split) for n in (1, 2, 3) for k in range(len(w) - n + 1))


def word_run_list(w):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                if j + q - i >= max(12, 2 * q):
                    best.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def periodic(docs, planted=True):
    out = []
    for i, text in docs:
        w = WORDS.findall(text or "")
        h = zlib.crc32(("" if i is None else str(i)).encode())
        n, g = len(w), h // 10
        if planted and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = word_run_list(w)
        gone = {k for s, size, q in found for k in range(s + q, s + size)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((i, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), digest("".join("%d,%d,%d\n" % x for x in found)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


RUNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_word_runs_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert columns(QUERIES["op13_word_runs"](spark, DATA), RUNS) == periodic(docs)


def test_word_runs_odd_rows(spark, odd):
    rows, docs = odd
    few = [r for r in rows if len(r[1] or "") < 20_000]  # plain Python is quadratic
    frame = docs.filter("coalesce(length(text), 0) < 20000")
    for how in (word_runs.WordRuns(), word_runs.WordRuns(words_per_batch=1, words_kept=1, tried_at_once=3)):
        assert columns(word_runs.report(frame, how), RUNS) == periodic(few, planted=False)
    assert word_runs.report(docs.filter("false")).count() == 0
    assert word_runs.report(docs.filter("doc_id = 5")).first().n_words == 30_000


@pytest.mark.parametrize("seed", range(6))
def test_word_runs_made(seed):
    """Batches of small alphabets, powers, copies and runs that touch a document's ends."""
    rng = random.Random(seed)
    for _ in range(60):
        docs = []
        for _ in range(rng.randint(1, 6)):
            k, n = rng.choice([1, 2, 3, 5, 30]), rng.choice([0, 1, 5, 13, 40, 150])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.5 and n > 12:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                w = w[:a] + [w[a + i % p] for i in range(n - a)]
            w *= rng.choice([1, 1, 1, 2, 3])
            docs.append(list(rng.choice(docs)) if docs and rng.random() < 0.3 else w)
        ids, owner = np.array([x for d in docs for x in d], np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        some = word_runs.with_repeats(ids, owner, len(docs))
        doc, begin, stop, period = word_runs.runs(ids, owner)
        first = np.cumsum([0, *map(len, docs)])
        for i, w in enumerate(docs):
            own = doc == i
            assert sorted(zip((begin[own] - first[i]).tolist(), (stop - begin)[own].tolist(), period[own].tolist(), strict=True)) == word_run_list(w)
            assert some[i] or not word_run_list(w)


def test_word_runs_grammar_derives_the_text():
    """Every nonterminal stands for the same words wherever it is derived, and one root spans each document."""
    rng = random.Random(2)
    ids = np.array([rng.randrange(4) for _ in range(3000)], np.int64)
    owner = np.repeat(np.arange(3), 1000)
    seen, spans = 0, set()
    for rules in word_runs.grammar(ids, owner):
        text = {}
        for r, a, b in zip(rules.rule.tolist(), rules.at.tolist(), rules.end.tolist(), strict=True):
            assert text.setdefault(r, ids[a:b].tolist()) == ids[a:b].tolist()
            spans.add((a, b))
        seen += len(rules.at)
    assert seen == 3 * 999 and {(0, 1000), (1000, 2000), (2000, 3000)} <= spans
