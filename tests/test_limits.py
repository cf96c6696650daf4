"""Time limits, budgets and places of matches."""

import time

import numpy as np
import pytest
import regex

from millrace.operators import search
from millrace.plans.limits import Refused, within


def sleepy(spark, seconds, partitions=4):
    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(0, partitions, 1, partitions).mapInPandas(wait, "id long")


def test_a_slow_search_is_refused_and_its_tasks_end(spark):
    spark.range(3).count()
    began = time.time()
    answer = within(spark, lambda: sleepy(spark, 60).collect(), 2)
    assert isinstance(answer, Refused) and "2 seconds" in str(answer)
    assert time.time() - began < 20
    tracker, until = spark.sparkContext.statusTracker(), time.time() + 20
    while tracker.getActiveStageIds() and time.time() < until:
        time.sleep(0.2)
    assert not tracker.getActiveStageIds()
    assert spark.range(7).count() == 7  # the session goes on


def test_a_limit_holds_over_several_jobs(spark):
    def rounds():
        for _ in range(100):
            sleepy(spark, 0.5, 1).collect()

    assert isinstance(within(spark, rounds, 2), Refused)


def test_results_and_errors_in_time(spark):
    assert within(spark, lambda: spark.range(5).count(), 60) == 5
    with pytest.raises(ZeroDivisionError):
        within(spark, lambda: 1 // 0, 60)
    with pytest.raises(ValueError):
        within(spark, lambda: 1, 0)
    assert not any(t.startswith("within-") for t in spark.sparkContext.getJobTags())


def test_places_of_many_matches():
    """10^6 lines with 10^5 matches: counting line ends from the start for each would take hours."""
    text = "\n".join("hit" if k % 10 == 3 else "x" for k in range(1_000_000))
    began = time.time()
    first, last = search.spans_in(text, regex.compile("hit"))
    assert time.time() - began < 20
    assert first.tolist() == last.tolist() == [k + 1 for k in range(3, 1_000_000, 10)]
    first, last = search.spans_in("a\nü𝄞\nb\n\nc", regex.compile("(?s)𝄞\nb\n|c|q?"))
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == [(2, 3), (5, 5)]
    assert search.spans_in("", regex.compile("x"))[0].dtype == np.int64


def test_budgets_of_a_page(spark):
    docs = [("r", "a", "hit\n" * 6 + "x" * 100), ("r", "b", "hit\n" * 5 + "y" * 1000), ("r", "c", "hit\n" * 4), ("r", "d", "no")]
    found = search.grep_multiline(spark.createDataFrame(docs, "repo_slug string, path string, content string"), "hit\n")
    shown = lambda **kw: sorted((r.place, r.path, r.line_number) for r in search.multiline_page(found, "hit\n", **kw).collect())
    assert shown() == [(1, "a", k) for k in range(1, 7)] + [(2, "b", k) for k in range(1, 6)] + [(3, "c", k) for k in range(1, 5)]
    # The first file is always read; a later one that does not fit is left out, and one behind it that fits is not.
    assert shown(budget=200, most_lines=2) == [(1, "a", 1), (1, "a", 2), (3, "c", 1), (3, "c", 2)]
    assert shown(budget=1, most_lines=1) == [(1, "a", 1)]
    assert shown(grep=search.Grep("hit", regex=True, page=2, page_size=2)) == [(1, "c", k) for k in range(1, 5)]
