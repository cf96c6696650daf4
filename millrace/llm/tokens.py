"""Ids of public tokenizers for many texts: distinct chunks are encoded once and their ids are looked up.

Merges of a byte pair vocabulary never reach beyond the pieces that its pattern cuts. A chunk is a run of whole pieces, so the
ids of a text are those of its chunks in order. A table gives every chunk a number, and the ids of all numbers lie in one array, so that
a batch of texts is one lookup per chunk and one gather. The encoders run inside Spark tasks; a worker keeps one per
vocabulary, with a bounded table. Texts that hold a special token's string are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space by Unicode, as the patterns of the vocabularies read it.
_WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class _Numbers(dict):
    """The number of each chunk; a new chunk gets the next one and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def of(self, names: np.ndarray) -> np.ndarray:
        """The numbers of different chunks; new ones are noted together."""
        numbers = np.fromiter(map(self.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(numbers < 0)
        fresh = names[new].tolist()
        numbers[new] = np.arange(len(self), len(self) + len(fresh))
        self.update(zip(fresh, range(len(self), len(self) + len(fresh))))
        self.new += fresh
        return numbers

    def __missing__(self, chunk: str | None) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class _Ids:
    """The ids of every number, one after the other in one array."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.count, self.noted = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def note(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """``ids``, of these sizes, are those of the next numbers."""
        while len(self.begin) < self.noted + len(sizes):
            self.begin, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.count))
        where = slice(self.noted, self.noted + len(sizes))
        self.count[where], self.begin[where] = sizes, self.used + np.cumsum(sizes) - sizes
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used, self.noted = self.used + len(ids), self.noted + len(sizes)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers, one after the other, and how many each has."""
        counts = self.count[numbers]
        upto = np.cumsum(counts)
        return self.ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.begin[numbers] - upto + counts, counts)], counts


class ChunkEncoder:
    """Unsigned 32-bit ids of texts, as the tokenizers library gives them without special tokens added."""

    def __init__(self, path: str, most: int = 700_000, block: int = 2000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.block = most, block
        self._clear()

    def _clear(self) -> None:
        self.table = _Ids()

    def chunks(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and how many each has."""
        raise NotImplementedError

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self) -> None:
        """Ids of the chunks that are new."""
        new, self.table.numbers.new = self.table.numbers.new, []
        for i in range(0, len(new), self.block):
            self.table.note(*self.encode_chunks(new[i : i + self.block]))

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the chunks of all texts, one after the other, and how many each text has."""
        cut = [self.chunks(text) if text else [] for text in texts]
        get = self.table.numbers.__getitem__
        numbers = [np.fromiter(map(get, chunks), np.int64, len(chunks)) for chunks in cut]
        return np.concatenate([*numbers, np.zeros(0, np.int64)]), np.fromiter(map(len, cut), np.int64, len(cut))

    def encode(self, texts: Iterable[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``end``, one after the other, and where each text's begin (and the last ends)."""
        if len(self.table.numbers) > self.most:
            self._clear()
        texts = list(texts)
        odd = {i: self.whole(text) for i, text in enumerate(texts) if text and any(x in text for x in self.special)}
        every, lengths = self._numbered(["" if i in odd else text or "" for i, text in enumerate(texts)])
        self._learn()
        found, counts = self.table.of(every)
        upto = np.concatenate(([0], np.cumsum(counts)))
        owners = np.concatenate(([0], np.cumsum(lengths)))
        sizes = np.diff(upto[owners])
        for i, ids in odd.items():
            sizes[i] = len(ids)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        # Where a chunk's ids go: behind those before it, and behind one closing id for each text before.
        shift = np.repeat(starts[:-1] - upto[owners[:-1]], np.diff(owners))
        out = np.empty(starts[-1], np.uint32)
        out[np.arange(upto[-1]) + np.repeat(shift, counts)] = found
        for i, ids in odd.items():
            out[starts[i] : starts[i + 1] - 1] = ids
        out[starts[1:] - 1] = end
        return out, starts


def _cut(ids: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> list[np.ndarray] | None:
    """``ids``, which end at ``ends``, cut at ``bounds``; None where an id reaches across one."""
    at = np.searchsorted(ends, bounds)
    if len(bounds) and (not len(ends) or at[-1] >= len(ends) or (ends[at] != bounds).any()):
        return None
    return np.split(ids, at + 1)[:-1]


def _mixed(first: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes in the order in which ``first`` takes from ``a`` or else from ``b``, both as ids and sizes."""
    sizes = np.empty(len(first), np.int64)
    sizes[first], sizes[~first] = a[1], b[1]
    ids, own = np.empty(int(sizes.sum()), np.uint32), np.repeat(first, sizes)
    ids[own], ids[~own] = a[0], b[0]
    return ids, sizes


def _looked_up(numbers: _Numbers, each: pa.DictionaryArray) -> np.ndarray:
    """The numbers of strings, each different one looked up once."""
    return numbers.of(each.dictionary.to_numpy(zero_copy_only=False))[each.indices.to_numpy()]  # to_pylist is many times slower


class ByteChunks(ChunkEncoder):
    """For byte-level vocabularies: a chunk is a word with the space before it, a word without one, or white space that stands alone.

    In the table a word stands for itself with a space before it, a carriage return marks a word without one, a tab marks white space.
    """

    _pattern = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
    #: What the quick way to cut a text can't stand.
    _unusual = ("  ", " \n", "\n ", "\n\n\n", *(c for c in _WHITE if c not in " \n"))

    def __init__(self, path: str, **kw) -> None:
        super().__init__(path, **kw)
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # one character stands for one byte

    def chunks(self, text: str) -> list[str]:
        if text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in self._unusual):
            return ("\r" + text.replace("\n", " \n \r")).split(" ")
        return [c[1:] if c[0] == " " and len(c) > 1 and c[1] not in _WHITE else c if c == "\n" else f"\t{c}" if c[0] in _WHITE else f"\r{c}" for c in self._pattern.findall(text)]

    def _run(self, text: str, sizes: list[int]) -> list[np.ndarray] | None:
        """Ids of the stretches of ``text`` with these numbers of bytes; None where an id reaches across two."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return _cut(ids, np.cumsum(self.lengths[ids]), np.cumsum(sizes))

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words are encoded as one text, which the lengths of the ids cut again."""
        out: dict[str, np.ndarray] = {"\r": np.zeros(0, np.uint32)}
        spaced = [c for c in chunks if c[0] not in _WHITE]
        bare = [c for c in chunks if c[0] == "\r" and len(c) > 1]
        out |= zip(spaced, self._run("".join(f" {c}" for c in spaced), [1 + len(c.encode()) for c in spaced]) or ())
        out |= zip(bare, (self._run("".join(f"{c[1:]}\n" for c in bare), [n for c in bare for n in (len(c.encode()) - 1, 1)]) or ())[::2])
        ids = [out[c] if c in out else self.whole(c if c == "\n" else c[1:] if c[0] in "\r\t" else f" {c}") for c in chunks]
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))


class WordChunks(ChunkEncoder):
    """For vocabularies that drop white space: a chunk is what stands between spaces, tabs and line ends.

    A new chunk of printable ASCII and Latin letters without an apostrophe is cut on to parts, which are runs of letters in lower case, single digits and runs of other characters. Parts
    occur again far more often than chunks, and each is encoded once. That holds for vocabularies that end a word by a suffix and know no case, which is probed; others encode chunks.
    """

    #: Characters that composition leaves alone and that have one lower-case form, and the parts of such chunks in lower case with a space between two of them.
    _plain = r"\A[!-&(-~À-ÖØ-öø-įı-ſ]*\z"
    _parts = re.compile("[a-zß-öø-ſ]+|[0-9]| |[^ a-z0-9ß-öø-ſ]+")
    _probe = ("Word.,!Ab12cÉß", "word .,! ab 1 2 céß")

    def __init__(self, path: str, **kw) -> None:
        super().__init__(path, **kw)
        self.model = self.tokenizer.model
        suffix = getattr(self.model, "end_of_word_suffix", None)
        self.ends: np.ndarray | None = None
        if suffix and np.array_equal(*map(self.whole, self._probe)) and all(self._alone(p) == self.whole(p).tobytes() for p in ("word", ".,!", "1")):
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _alone(self, part: str) -> bytes:
        """The ids of a part of ASCII, which stands for itself in the vocabulary."""
        return np.array([t.id for t in self.model.tokenize(part)], np.uint32).tobytes()

    def _clear(self) -> None:
        super()._clear()
        self.parts = _Ids()
        self._space = self.parts.numbers[" "]  # stands between chunks and has no ids
        self.parts.numbers.new = []
        self.parts.note(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts are cut by Arrow, and each chunk of a batch is looked up once."""
        rows = pa.array([t.replace("\n", " ").replace("\t", " ").replace("\r", " ") if t else None for t in texts], pa.large_string())
        cut = pc.split_pattern(rows, " ")
        each = cut.flatten().dictionary_encode()
        return _looked_up(self.table.numbers, each), pc.fill_null(pc.list_value_length(cut), 0).to_numpy().astype(np.int64)

    def _by_offsets(self, chunks: list[str]) -> list[np.ndarray]:
        e = self.tokenizer.encode_batch([" ".join(chunks)], add_special_tokens=False)[0]
        begins = np.cumsum([0, *(len(c) + 1 for c in chunks)])
        at = np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), begins)
        return np.split(np.array(e.ids, np.uint32), at[1:-1])

    def _learn_parts(self) -> None:
        """Parts of ASCII go to the merges as they are; others are encoded as one text, which the ends of words cut again."""
        new, self.parts.numbers.new = self.parts.numbers.new, []
        is_ascii = np.fromiter(map(str.isascii, new), bool, len(new))
        tokenize = self.model.tokenize
        found = [tokenize(p) for p in new if p.isascii()]
        known = np.array([t.id for tokens in found for t in tokens], np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        self.parts.note(*_mixed(is_ascii, known, self._as_one([p for p in new if not p.isascii()])))

    def _as_one(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(parts):
            return ids, np.diff(ends, prepend=0)
        each = [self.whole(p) for p in parts]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.zeros(len(chunks), bool) if self.ends is None else pc.match_substring_regex(pa.array(chunks, pa.large_string()), self._plain).to_numpy(zero_copy_only=False)
        quick = list(compress(chunks, plain))
        cut = self._parts.findall(" ".join(quick).lower())
        numbers = _looked_up(self.parts.numbers, pa.array(cut, pa.large_string()).dictionary_encode())
        if self.parts.numbers.new:
            self._learn_parts()
        ids, counts = self.parts.of(numbers)
        sizes = np.bincount(np.cumsum(numbers == self._space), counts, len(quick)).astype(np.int64)
        others = self._by_offsets(list(compress(chunks, ~plain))) if len(quick) < len(chunks) else []
        return _mixed(plain, (ids, sizes), (np.concatenate([*others, np.zeros(0, np.uint32)]), np.array([len(x) for x in others], np.int64)))


@lru_cache(maxsize=2)
def encoder(path: str, kind: str = "byte") -> ChunkEncoder:
    """The worker's encoder; ``kind`` is ``byte`` or ``word``."""
    return {"byte": ByteChunks, "word": WordChunks}[kind](path)
