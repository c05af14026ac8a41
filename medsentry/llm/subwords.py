"""Exact subword ids of whole texts, word by word.

A tokenizer whose normalizer and pre-tokenizer never act across ASCII white space gives a text
the ids of its words, one after another. So each distinct word is tokenized once per worker and
texts are assembled from a table of words, which is an order of magnitude faster than
tokenizing them whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Contractions, runs of letters, single digits, runs of other characters: the pre-tokenizer of
#: the word BPE file, for the letters of ASCII and Latin-1 (fixed values).
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Words of these characters alone are split and merged here; all others go through the library.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    """Ids of single words under a BPE file with word ends, as unsigned 32-bit little-endian bytes.

    Plain words are merged by rank with a byte-pair core: 0xFF, which UTF-8 never has, marks the
    word's end, and joining it to the last byte outranks every merge. Words with characters
    beyond Latin-1 or with special-token brackets are given to the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = _byte_letters(ByteLevel)
        to_byte = {c: bytes([b]) for b, c in enumerate(shown)}

        def raw(symbol: str) -> bytes:
            end = symbol.endswith("</w>")
            return b"".join(to_byte[c] for c in (symbol[:-4] if end else symbol)) + b"\xff" * end

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"].get(shown[b], 0) for b in range(256)] + [model["vocab"].get(shown[b] + "</w>", 0) for b in range(255)]
        for a, b in pairs:
            if ranks.setdefault(raw(a) + raw(b), len(ids)) == len(ids):
                ids.append(model["vocab"][a + b])
        self.core = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.size, self.own = self.library.get_vocab_size(), len(ids)
        #: Id of each rank of the core, and after these of each of the library's ids.
        self.ids = np.array([*ids, *range(self.size)], np.uint32)

    def ranks(self, word: bytes) -> list[int]:
        """The word's ids as places in ``self.ids``."""
        if word.isalpha():  # ASCII letters: one part
            return self.core.encode_single_piece(word.lower() + b"\xff")
        text = word.decode()
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return [self.own + i for i in self.library.encode(text, add_special_tokens=False).ids]
        return [i for part in _SPLIT.findall(text.lower()) for i in self.core.encode_single_piece(part.encode() + b"\xff")]

    def numbers(self, word: bytes) -> list[int]:
        """The word's ids."""
        return self.ids[self.ranks(word)].tolist()

    def __call__(self, word: bytes) -> bytes:
        return array("I", self.numbers(word)).tobytes()


def _byte_letters(byte_level) -> list[str]:
    """The visible character that stands for each byte: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    letters = [chr(b) if b in printable else chr(next(other)) for b in range(256)]
    assert set(letters) == set(byte_level.alphabet())
    return letters


class Table(dict):
    """Word -> value. The first ``keep`` words stay; later ones share a second table that is emptied when full.

    Frequent words occur early, so they are in the lasting part; memory is bounded either way.
    Words longer than ``longest`` bytes are computed anew each time.
    """

    def __init__(self, compute: Callable, keep: int = 150_000, spare: int = 100_000, longest: int = 64):
        super().__init__()
        self.compute, self.keep, self.most, self.longest, self.spare = compute, keep, spare, longest, {}

    def __missing__(self, word):
        value = self.spare.get(word)
        if value is None:
            value = self.compute(word)
            if len(word) <= self.longest:
                if len(self) < self.keep:
                    self[word] = value
                else:
                    if len(self.spare) >= self.most:
                        self.spare.clear()
                    self.spare[word] = value
        return value


class WordIds(dict):
    """Word -> number, with the ids of all numbered words in one array. Number 0 is the end of a text.

    The words ``first``, given with line feeds between them, have the numbers from 1 on and always stay.
    So do the next ones up to ``keep`` words; ``trim`` (between texts) drops later ones when there are
    ``spare`` more, or when the words have ``room`` bytes.
    """

    def __init__(self, bpe: WordBpe, end: int, first: bytes = b"", keep: int = 200_000, spare: int = 100_000, room: int = 64_000_000):
        super().__init__()
        self.first, given = first, first.split()
        self.fixed = len(given) + 1
        keep = max(keep, self.fixed)
        most = keep + spare
        self.bpe, self.keep, self.most, self.room = bpe, keep, most, room
        self.names, self.held = [b""], 0
        self.flat, self.begin, self.length = np.zeros(4 * most, np.uint32), np.zeros(most + 1, np.int64), np.zeros(most, np.int64)
        self.flat[0], self.begin[1], self.length[0] = end, 1, 1
        for at in range(0, len(given), 10_000):
            self._add(given[at : at + 10_000])

    def _add(self, words: list[bytes]) -> None:
        at, names = len(self.names), self.names
        for word in words:
            if word not in self:
                self[word] = len(names)
                names.append(word)
        new = [self.bpe.ranks(word) for word in names[at:]]
        n = np.fromiter(map(len, new), np.int64, len(new))
        a = int(self.begin[at])
        b = a + int(n.sum())
        while len(names) > len(self.length):
            self.begin, self.length = np.concatenate((self.begin, np.zeros_like(self.begin))), np.concatenate((self.length, np.zeros_like(self.length)))
        while b > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[a:b] = self.bpe.ids.take(np.fromiter(chain.from_iterable(new), np.int64, b - a))
        self.length[at : len(names)], self.begin[at + 1 : len(names) + 1] = n, a + np.cumsum(n)
        self.held += sum(map(len, names[at:]))

    def of(self, words: list[bytes]) -> np.ndarray:
        numbers = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        missing = np.nonzero(numbers < 0)[0]
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            self._add(new)
            numbers[missing] = [self[w] for w in new]
        return numbers

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and how many each word has."""
        n = self.length.take(numbers)
        ends = np.cumsum(n)
        return self.flat.take(np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin.take(numbers) - (ends - n), n)), n

    def trim(self) -> None:
        while len(self.names) > self.most or self.held > self.room and len(self.names) > self.fixed:
            keep = max(self.fixed, self.keep if len(self.names) > self.most else (len(self.names) + 1) // 2)
            for word in self.names[keep:]:
                del self[word]
                self.held -= len(word)
            del self.names[keep:]


def distinct_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, A-Z lower-cased; each word's place among them; and how many words each text has.

    Arrow splits at the same six bytes as ``bytes.split``, but has an empty word where white space
    begins or ends a text, and one for an empty text; these are dropped.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    encoded = lists.flatten().dictionary_encode()
    which, lengths = encoded.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    _, starts, raw = encoded.dictionary.cast(pa.large_binary()).buffers()
    at, raw = np.frombuffer(starts, np.int64, len(encoded.dictionary) + 1).tolist(), raw.to_pybytes() if raw else b""
    names = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
    if b"" in names:
        empty = names.index(b"")
        real = which != empty
        lengths -= np.bincount(np.repeat(np.arange(len(lengths)), lengths)[~real], minlength=len(lengths))
        which = which[real]
        which = which - (which > empty)
        del names[empty]
    return names, which, lengths


def word_pieces(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """The place of a piece's first text, and its ``distinct_words``: texts of about ``most`` bytes together, or one.

    A word that comes often in a piece is looked up in the large table of words once, not each time.
    """
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, *distinct_words(texts.slice(first, stop - first))
        first = stop


def with_ends(numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of texts' words, with the number 0, a text's end, after each text."""
    out = np.zeros(len(numbers) + len(lengths), np.int64)
    out[np.arange(len(numbers)) + np.repeat(np.arange(len(lengths)), lengths)] = numbers
    return out


def runs(lengths: np.ndarray, most: int) -> Iterator[tuple[slice, slice]]:
    """Which texts, and which of their places: consecutive texts of ``most`` places or the fewest above."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        begin = int(ends[first - 1]) if first else 0
        stop = min(len(lengths), int(np.searchsorted(ends, begin + most)) + 1)
        yield slice(first, stop), slice(begin, int(ends[stop - 1]))
        first = stop


@cache
def word_bpe(path: str) -> WordBpe:
    """One for each process: Python workers run many tasks."""
    return WordBpe(path)


_tables: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, end: int, first: bytes = b"") -> WordIds:
    """One for each process, as long as it is asked for with the same ``first`` words."""
    table = _tables.get((path, end))
    if table is None or table.first != first:
        _tables.pop((path, end), None)
        del table  # before the next one is made
        table = _tables[path, end] = WordIds(word_bpe(path), end, first)
    return table
