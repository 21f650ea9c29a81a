"""Byte-pair encoding by forced boundaries, for vocabularies with word ends.

A byte pair that occurs inside no vocabulary token is never merged across, so a
text may be cut there: the fragments are encoded on their own and their ids are
put one after the other.  White space is in no token of such a vocabulary, so
every text falls into words, words into the runs of the tokenizer's own split
pattern, and all new runs of a text, of any script, are cut in one pass over
their bytes.  The last fragment of a run carries the word end.

Runs repeat, so a worker keeps the encodings of those it has met, up to a number
of bytes; long ones are encoded anew each time.

Words with characters outside the plain Latin blocks (where normalisation or
letter classes could differ) are normalised and split by the library, words
with special tokens are given to it whole; it also makes the merges of every
fragment.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import ChainMap
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import accumulate, chain

import numpy as np
from tokenizers import Tokenizer, models

#: Bytes of encodings that a worker remembers, about.
REMEMBERED_BYTES = 64 << 20
#: Longer runs (in characters) are not remembered.
LONGEST = 64
#: Bytes that an entry takes besides what it says.
ENTRY_BYTES = 200

#: Characters of a text that are cut into runs at once.
PIECE_CHARS = 1 << 19

_SPACES = " \t\n\r\x0b\x0c"
_SPACE = re.compile(f"[{_SPACES}]")
_BREAKS = dict.fromkeys(map(ord, _SPACES), " ")


def _latin(kind: str) -> str:
    """Characters of the Latin blocks above ASCII of a general category."""
    return "".join(chr(c) for c in range(0xA1, 0x250) if unicodedata.category(chr(c))[0] == kind)


#: Anything but ASCII text and Latin signs that are composed already and lower-cased one by one.
_ODD = re.compile(r"[^ \t\n\r\x0b\x0c!-~\xa1-\u012f\u0131-\u024f]")

#: The vocabulary's split pattern (a fixed value), its letter and digit classes written out for such text.
_RUN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_latin('L')}]+|[0-9{_latin('N')}]|[^ \t\n\r\x0b\x0ca-z0-9{_latin('L')}{_latin('N')}]+"
)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def inner_pairs(tokens: Iterable[str], word_end: str = "</w>") -> bytearray:
    """A flag for each of the 65,536 byte pairs: 1 if it occurs inside a token."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    flags = bytearray(1 << 16)
    for token in tokens:
        data = [back.get(c) for c in token.removesuffix(word_end)]
        for x, y in zip(data, data[1:]):
            if x is not None and y is not None:
                flags[x << 8 | y] = 1
    return flags


class Memory:
    """Encodings by run (``known``); all are forgotten when they take more than ``limit`` bytes."""

    def __init__(self, limit: int):
        self.known: dict[str, object] = {}
        self.limit, self.held = limit, 0

    def make_room(self) -> None:
        if self.held > self.limit:
            self.known, self.held = {}, 0

    def keep(self, runs: list[str], values: list, size: int) -> None:
        """Remember the values, of ``size`` bytes in all, of so many runs."""
        self.held += ENTRY_BYTES * len(runs) + sum(map(len, runs)) + size
        self.known.update(zip(runs, values))


class WordEncoder:
    """Ids of texts as the tokenizer of the file gives them."""

    def __init__(self, path: str):
        self._whole = Tokenizer.from_file(path)
        self._whole.no_truncation()
        self._whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._inner = models.BPE(vocab=vocab, merges=merges)
        self._last = self._whole.model
        self._special = [t["content"] for t in spec["added_tokens"]]
        flags = inner_pairs(vocab, model["end_of_word_suffix"])
        if any(flags[s << 8 | b] or flags[b << 8 | s] for s in _SPACES.encode() for b in range(256)):
            raise ValueError("a token of this vocabulary spans white space; it can't be cut there")
        self._pairs = np.frombuffer(bytes(flags), bool)
        self._alphabet = dict(enumerate(byte_alphabet()))
        self._back = {ord(c): b for b, c in self._alphabet.items()}
        size = self._whole.get_vocab_size(with_added_tokens=True)
        #: The string of each id.
        self.shown = [self._whole.id_to_token(i) for i in range(size)]
        self._numbers = [f"{i} " for i in range(size)]
        self._tokens = [f"{t} " for t in self.shown]
        self._ids, self._strings = Memory(REMEMBERED_BYTES), Memory(REMEMBERED_BYTES)

    def cuts(self, data: bytes) -> np.ndarray:
        """Places in ``data`` where a boundary is forced."""
        codes = np.frombuffer(data, np.uint8).astype(np.uint16)
        return np.flatnonzero(~self._pairs[codes[:-1] << 8 | codes[1:]]) + 1

    def _encode(self, runs: list[str]) -> list[list[int]]:
        """Ids of runs of the split pattern; their bytes are cut in one pass."""
        data = " ".join(runs).encode()
        shown = data.decode("latin-1").translate(self._alphabet)
        inner, last, space = self._inner.tokenize, self._last.tokenize, self._alphabet[32]
        out, ids, at = [], [], 0
        for end in self.cuts(data).tolist():  # a space is cut off on both sides
            part = shown[at:end]
            if part == space:
                out.append(ids)
                ids = []
            else:
                ids += [t.id for t in (last if shown[end] == space else inner)(part)]
            at = end
        out.append(ids + [t.id for t in last(shown[at:])])
        return out

    def _odd(self, word: str) -> list[int]:
        """Ids of a word with other characters or special tokens."""
        if any(s in word for s in self._special):
            return self._whole.encode(word, add_special_tokens=False).ids
        pieces = self._whole.pre_tokenizer.pre_tokenize_str(self._whole.normalizer.normalize_str(word))
        runs = [bytes(map(self._back.__getitem__, map(ord, p))).decode() for p, _ in pieces]
        return [i for ids in self._encode(runs) for i in ids] if runs else []

    def runs(self, text: str | None) -> list[str]:
        """The runs of a text, in order; words with other characters or special tokens are led by a space."""
        if not text:
            return []
        if not _ODD.search(text) and not any(s in text for s in self._special):
            return _RUN.findall(text.lower())
        out = []
        for word in text.translate(_BREAKS).split(" "):
            if word and (_ODD.search(word) or any(s in word for s in self._special)):
                out.append(" " + word)
            elif word:
                out += _RUN.findall(word.lower())
        return out

    def _known(self, runs: list[str], memory: Memory, made: Callable[[list[list[int]]], tuple]) -> Mapping[str, object]:
        """What ``made`` makes of the ids of the runs, for each of them; it gives the size of all in bytes as well."""
        memory.make_room()
        known = memory.known
        new = list(set(runs).difference(known))
        if not new:
            return known
        plain = [r for r in new if r[0] != " " and len(r) <= LONGEST]
        if plain:
            memory.keep(plain, *made(self._encode(plain)))
        if len(plain) == len(new):
            return known
        long = {}
        for run in set(new).difference(plain):
            values, size = made([self._odd(run[1:])] if run[0] == " " else self._encode([run]))
            if len(run) <= LONGEST:
                memory.keep([run], values, size)
            else:
                long[run] = values[0]
        return ChainMap(long, known)

    def ids(self, text: str | None) -> bytes:
        """Ids of the text as 32-bit numbers in the machine's order."""
        out = []
        for piece in pieces(text or ""):
            runs = self.runs(piece)
            out.extend(map(self._known(runs, self._ids, _packed).__getitem__, runs))
        return b"".join(out)

    def strings(self, text: str | None) -> tuple[str, str]:
        """Ids of the text in decimal, and their tokens, each joined by one space."""
        both = []
        for piece in pieces(text or ""):
            runs = self.runs(piece)
            both.extend(map(self._known(runs, self._strings, self._spaced).__getitem__, runs))
        return "".join([x[0] for x in both])[:-1], "".join([x[1] for x in both])[:-1]

    def _spaced(self, ids: list[list[int]]) -> tuple[list[tuple[str, str]], int]:
        numbers, tokens = self._numbers.__getitem__, self._tokens.__getitem__
        values = [("".join(map(numbers, x)), "".join(map(tokens, x))) for x in ids]
        return values, 100 * len(values) + sum([len(x) + 2 * len(y) for x, y in values])


def _packed(ids: list[list[int]]) -> tuple[list[bytes], int]:
    data = np.array(list(chain.from_iterable(ids)), np.uint32).tobytes()
    ends = list(accumulate([4 * len(x) for x in ids], initial=0))
    return [data[a:b] for a, b in zip(ends, ends[1:])], len(data)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that end at white space."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary file, made once in each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
