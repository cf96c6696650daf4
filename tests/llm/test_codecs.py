"""Exact round trips of the range coder, and cuts and bins of the packing."""

import numpy as np
import pytest

from millrace.llm.packing import HarmonicBins, pieces
from millrace.llm.range_coder import compress, decompress


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 40])
@pytest.mark.parametrize("most", [1, 5, 70_000, 2**32 - 1])
def test_round_trip(n, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype("<u4")
    assert (decompress(compress(ids, block=16)) == ids).all()


@pytest.mark.parametrize("at", [-20, 32, 40])
def test_damage_is_found(at):
    raw = bytearray(compress(np.arange(64, dtype="<u4"), block=16))
    raw[at] ^= 1
    with pytest.raises(ValueError):
        decompress(bytes(raw))


def test_files_are_smaller_than_what_plain_coders_make(docs_ids=400_000):
    """Ids of the given documents: below zlib and zstd on 16-bit ids, and below the entropy of single ids."""
    import zlib

    import duckdb
    import public_tokenizers
    import zstandard
    from tokenizers import Tokenizer

    texts = [r[0] for r in duckdb.sql("SELECT coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.concatenate([np.array([*e.ids, 1], "<u4") for e in coder.encode_batch_fast(texts, add_special_tokens=False)])[:docs_ids]
    n = np.bincount(ids)
    n = n[n > 0]
    entropy = float((n * np.log2(len(ids) / n)).sum()) / 8
    plain = ids.astype("<u2").tobytes()
    raw = compress(ids)
    assert len(raw) < min(entropy, len(zlib.compress(plain, 6)), len(zstandard.compress(plain, 3)))
    assert (decompress(raw) == ids).all()


def test_rare_and_frequent_ids():
    """Escapes for rare ids, one id alone, and ids of 24 bits."""
    rng = np.random.default_rng(5)
    for ids in (np.full(5000, 7), rng.zipf(1.3, 20_000) % (1 << 24), np.concatenate((np.zeros(9000, int), rng.integers(0, 1 << 24, 3000))), rng.integers(0, 1 << 32, 3000)):
        ids = ids.astype("<u4")
        assert (decompress(compress(ids, block=128)) == ids).all()


def test_pieces_and_bins():
    bins, rows = HarmonicBins(1024, 0), []
    for doc, n in enumerate([1, 513, 700, 1024, 5000, 2, 341]):
        cut = pieces(n, 1024, 3)
        assert sum(cut) == n and max(cut) <= 1024
        for length in cut:
            rows += bins.add([doc, 0, length, 0, n])
    rows += bins.close()
    used = {}
    for r in sorted(rows, key=lambda r: (r[5], r[6])):
        assert r[6] == used.get(r[5], 0)
        used[r[5]] = r[6] + r[2]
    assert max(used.values()) <= 1024 and sum(used.values()) == sum([1, 513, 700, 1024, 5000, 2, 341])


def test_ids_of_odd_texts():
    """Chunks that are cut to parts, and those that are not, give the ids of the whole text."""
    import random

    import public_tokenizers

    from millrace.llm.tokens import encoder

    draw = random.Random(1)
    pieces = ["abC", "X", "!?", ".", "'", "'s", "12", "é", "É", "\x1c", "\x00", "\x7f", "</w>", "<|", "|>", " ", "\n", "\t", "́", "ſ", "K", "_", "endoftext", "<|endoftext|>", "\xa0", "½", "Ÿ", "ß", "İ", "ı", "ŉ", "×", "÷", "Ĳ", "µ", "ª"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(25))) for _ in range(3000)]
    for kind, path in (("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")):
        e = encoder(public_tokenizers.path(path), kind)
        ids, starts = e.encode(texts, 1)
        for i, text in enumerate(texts):
            assert ids[starts[i] : starts[i + 1] - 1].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_parts_of_new_chunks_are_cut_and_looked_up_together():
    import public_tokenizers

    from millrace.llm.tokens import WordChunks

    class Counted:
        calls = 0

        def findall(self, text):
            Counted.calls += 1
            return WordChunks._parts.findall(text)

    encoder = WordChunks(public_tokenizers.path("word_bpe_49k.json"))
    encoder._parts = Counted()
    texts = [" ".join(f"Wort{i}x, Ünd{i}-{j} it's" for i in range(40)) for j in range(30)] + ["", None, "  a  Éß b ", "Σας 日本語 don't", "x"]
    ids, starts = encoder.encode(texts, 1)
    assert 0 < Counted.calls <= 2  # a block of new chunks is cut at once, not each by itself
    for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert ids[a:b].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_a_part_of_a_file_may_lack_its_greatest_ids(monkeypatch):
    from millrace.llm import range_coder

    monkeypatch.setattr(range_coder, "LANES", 2)
    ids = np.array([900] * 32 + [3] * 20, "<u4")  # the second two blocks hold no 900, which is listed
    assert (decompress(compress(ids, block=16)) == ids).all()


def test_each_chunk_of_a_batch_is_looked_up_once(monkeypatch):
    import public_tokenizers

    from millrace.llm.tokens import WordChunks, _Numbers

    seen, of = [], _Numbers.of
    monkeypatch.setattr(_Numbers, "of", lambda self, names: seen.append(len(names)) or of(self, names))
    encoder = WordChunks(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Straße\tQuéŝ straße, it's 12\r\n" * 50, None, "", " ", "Straße İx ıŉ ﬁn\u0085a   x\x00y", "b" * 300 + " Å Å é ſ×÷ø", "日本 12"] * 3
    ids, starts = encoder.encode(texts, 1)
    assert seen[0] == len({c for t in texts if t for c in t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")})
    for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert ids[a:b].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], text
