"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random

import public_tokenizers
import pytest

from millrace.llm import html_extract, line_dedup, media, mixing, ngram_join, packing, quality, suffix_dedup, token_files, url_filter

LONG = " ".join(f"word{i % 997}" for i in range(20_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix jugs of strong liquid quartz near the old harbour bridge every morning before noon arrives"
ROWS = [
    (1, PROSE, "en", "a", 10), (1, PROSE, "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "   \n\t", "en", None, 5), (5, LONG, "en", "b", 1), (None, PROSE + " again", None, "b", 3),
    (6, "héllo wörld   naïve\x00 x", "fr", "", 4), (7, "one two three", "en", "a", 3), (8, "one two three", "de", "c", 3), (None, None, None, None, None), (9, "\n\n", "en", "a", 2), (10, "<|endoftext|> x <|startoftext|>", "en", "a", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
REPORTS = {
    "suffix": suffix_dedup.report, "quality": quality.report, "packing": lambda d: packing.packed(d, packing.Packing(BYTE)), "tokens": lambda d: token_files.report(d, token_files.TokenFiles(WORD)),
    "lines": line_dedup.report, "mixing": mixing.report, "media": media.report, "ngram": ngram_join.joined,
}
FILTERS = {"quality": quality.filtered, "lines": line_dedup.filtered, "ngram": ngram_join.deduplicated, "mixing": mixing.sampled}


def _clashing(df):
    extra = ("row", "uid", "node", "n_words", "size", "label", "words", "slice", "key", "component_id", "kept", "source_size", "gone", "text_")
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in extra))


@pytest.fixture(scope="module")
def docs(spark):
    return _clashing(spark.createDataFrame(ROWS, SCHEMA))


@pytest.mark.parametrize("name", REPORTS)
def test_report_has_every_row(docs, name):
    rows = REPORTS[name](docs).collect()
    ids = [r.doc_id for r in rows]
    if name == "packing":
        whole = {}
        for r in rows:
            whole.setdefault((r.doc_id, r.doc_tokens), 0)
            whole[(r.doc_id, r.doc_tokens)] += r.length
        assert set(ids) == {r[0] for r in ROWS}
        assert sum(whole.values()) == sum(r.doc_tokens for r in rows if r.start == 0)
    else:
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", REPORTS)
def test_report_of_nothing(spark, name):
    assert REPORTS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filter_keeps_columns(docs, spark, name):
    out = FILTERS[name](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r.row == "x" for r in rows)
    assert FILTERS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_values(docs):
    by = {}
    for r in media.report(docs).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0] == by[1][1]
    assert by[2][0].payload_bytes == 64 and by[2][0].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and by[3][0].media_sha256 == by[2][0].media_sha256
    words = {r.doc_id: r for r in quality.report(docs).collect()}
    assert (words[5].n_words, words[2].n_words, words[4].n_words) == (20_000, 0, 0)
    assert not words[2].kept and words[2].base_failed
    near = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.joined(docs).collect()}
    assert near[(1, len(PROSE.split()) - 4)] == 1 and near[(7, 1)] == 7 and near[(8, 1)] == 7 and near[(2, 0)] == 2
    cut = {r.doc_id: r for r in suffix_dedup.report(docs).collect()}
    assert cut[2].n_bytes == 0 and cut[1].n_removed == len(PROSE) if len(PROSE) >= 200 else cut[1].n_removed == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "no host", ""), (3, "HTTP://Sub.Example.NET/en/x?y#z", "<article><p>a</article>"), (3, "HTTP://Sub.Example.NET/en/x?y#z", "<article><p>a</article>"), (4, "http://x.org/fr/", "<p>open <b>tag"), (None, "http://x.net", "<p"), (5, "http://example.com/de/1", "<div>" * 300 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS exemplar", "'z' AS verdict")
    by = {}
    for r in url_filter.judged(pages).collect():
        by[r.page_id] = r
    assert (by[3].host, by[3].path, by[3].rule, by[3].verdict) == ("sub.example.net", "/en/x", "example.net/en/", "allow")
    assert (by[1].host, by[1].path, by[2].host, by[None].rule, by[None].path) == ("", "", "", None, "")
    assert by[4].verdict == "allow" and by[5].verdict == "block"
    texts = {r.page_id: r.text for r in html_extract.extracted(pages).collect()}
    assert texts == {1: "", 2: "", 3: "a", 4: "open tag", None: "", 5: "deep"}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judged(empty).collect() == [] and html_extract.extracted(empty).collect() == []


def test_shared_passage_is_stored_once(spark):
    """A passage in documents of usual length, between texts that differ."""
    import random

    draw = random.Random(1)
    text = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = text(3000)
    docs = spark.createDataFrame([(i, text(300 + 37 * i) + passage + text(250)) for i in range(8)], SCHEMA.split(",")[0] + ", text string")
    import zstandard

    recipes, containers, common = media.store(docs, media.ChunkStore())
    lengths = {d: n for r in recipes.collect() for d, n in zip((bytes(r.digests[i : i + 16]) for i in range(0, len(r.digests), 16)), memoryview(bytes(r.lengths)).cast("I"))}
    unpack = zstandard.ZstdDecompressor().decompress
    stored = sum(len(unpack(r.data)) if r.data else 0 for r in containers.collect()) + sum(len(unpack(r.data)) for r in common.collect())
    payloads = sum(r.payload_bytes for r in recipes.collect())
    assert stored == sum(lengths.values()) < payloads - 7 * len(passage) / 2
    facts = {r.doc_id: r for r in media.report(docs).collect()}
    assert all(facts[r.doc_id].payload_sha256 == hashlib.sha256(media.payload(r.text, 64)).hexdigest() for r in docs.collect())


def test_article_that_is_not_the_text(spark):
    """A teaser in an ``article`` doesn't hide the page's text in a ``div``, whether the teaser varies or is template."""
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"http://a.net/{i}", f"<body><article class=teaser>Read part {i}</article><div class=text><p>{body(i)}</p></div></body>") for i in range(8)]
    rows += [(10 + i, f"http://b.net/{i}", f"<body><article class=teaser>{'The same words. ' * 6}</article><div class=text><p>{body(i)}</p></div></body>") for i in range(8)]
    rows += [(20 + i, f"http://c.net/{i}", f"<body><div class=teaser>Read part {i}</div><article><p>{body(i)}</p></article></body>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k + i: body(i) for k in (0, 10, 20) for i in range(8)}


def test_short_lines_with_one_change(spark):
    """Lines of 45 characters, one inner character changed, against brute force: nearly all pairs above the threshold share a component."""
    import random

    import numpy as np

    from millrace.llm.hashing import character_shingles, lowered

    draw, how = random.Random(3), line_dedup.LineDedup()
    assert how.shingle == 5 and 1 - (1 - 0.75**how.rows) ** how.bands > 0.999
    lines = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(44)) + "x" for _ in range(300)]
    changed = [x[:22] + "#" + x[23:] for x in lines]
    raw = lambda x: np.frombuffer(x.encode(), np.uint8)
    sets = [set(character_shingles(lowered(raw(x)), np.array([0, len(x)]), how.shingle)[0].tolist()) for x in lines + changed]
    near = sum(len(a & b) >= 0.75 * len(a | b) for a, b in zip(sets[:300], sets[300:], strict=True))
    assert near == 300
    rows = {r.doc_id: r for r in line_dedup.report(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(changed))], "doc_id long, text string")).collect()}
    assert rows[1].n_removed == 0 and rows[2].n_removed >= 299


def test_hot_anchor_is_split(spark):
    """A passage of 130 bytes between texts that differ, some of which repeat longer strings around it: groups stay small, results are the same."""
    import random

    import pyarrow as pa

    draw = random.Random(7)
    text = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, left, right = text(130), [text(100) for _ in range(3)], [text(100) for _ in range(3)]
    rows = [(i, text(150) + passage + text(150)) for i in range(40)] + [(100 + i, text(60) + left[i % 3][20:] + passage + text(90)) for i in range(9)] + [(200 + i, text(90) + passage + right[i % 3][:80] + text(60)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split, whole = (sorted(suffix_dedup.report(docs, suffix_dedup.SuffixDedup(rows_at_once=n)).collect()) for n in (8, 30_000))
    assert split == whole and sum(r.n_removed > 0 for r in whole) == 18
    _, _, cut, _ = suffix_dedup._plans(suffix_dedup.SuffixDedup(), 2)
    hot = [{"place": 150, "anchor": 5, "hot": True}]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[:40]]), pa.array([r[1].encode() for r in rows[:40]]), pa.array([hot] * 40)], ["uid", "text", "asked"])
    groups = [x for b in cut([batch]) for x in b.column(0).to_pylist()]
    assert len(groups) == len(set(groups)) == 80


def test_quality_filter_tells_nulls_apart(spark):
    """Documents of one text whose language and source differ only in which one is null are judged each for itself, as the report does."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, " ".join(word(5) for _ in range(30)), lang, source) for i, (lang, source) in enumerate([(None, "zz")] * 150 + [("zz", None)] * 150 + [(None, None)] * 5)]
    odd = " ".join(word(9) for _ in range(30))
    rows += [(5000, odd, None, "zz"), (5001, odd, "zz", None), (5002, odd, None, None), (5003, None, None, None), (None, odd, "zz", "zz")]
    rows += [(6000 + i, " ".join(word(9) for _ in range(30)), "zz", None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = sorted((r.doc_id for r in quality.report(docs).filter("kept").collect()), key=repr)
    assert sorted((r.doc_id for r in quality.filtered(docs).collect()), key=repr) == kept
    assert 5001 in kept and 5000 not in kept


def test_repeated_rows_with_other_columns(spark):
    """Of rows with one id and text the first by their other columns keeps its lines, however they are dealt."""
    rows = [(1, "one line of words\nand another one", x) for x in ("c", "a", "b")]
    for parts in (1, 3):
        got = line_dedup.filtered(spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(parts)).collect()
        assert sorted((r.x, r.text) for r in got) == [("a", rows[0][1]), ("b", ""), ("c", "")]
