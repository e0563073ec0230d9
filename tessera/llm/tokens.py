"""Token ids of whole texts, with a cache of words.

The vocabulary file splits a text before each space that follows a character
other than white space, so such stretches can be encoded apart and their ids
remembered. Texts where white space stands before a space are encoded whole.
Of many texts at once Arrow finds the different stretches, so each is looked up once.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a text that is encoded by itself.
LONG = 1 << 20
_SPLITS_ALIKE = re.compile(r"\s ")
#: ASCII characters that are neither letters, digits nor white space, except the apostrophe, which starts contractions.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class CachedEncoder(dict):
    """``ids(text)`` of a tokenizers file. As a dict: a stretch between spaces to the ids' bytes, with its leading space.

    It remembers at most about ``2 * most`` stretches: a full dict becomes the older one, from
    which what is met again moves over."""

    def __init__(self, path: str, most: int = 350_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.most, self.letters = self.tokenizer.model, most, byte_letters()
        self.marks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str, space: str) -> bytes:
        if not word.isalpha():  # letters of any script, as the vocabulary's pattern has them
            return self._whole(space + word)
        piece = (space + word).encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _marked(self, chunk: str, space: str) -> bytes:
        """A word with marks behind it: letters and marks never share a token."""
        word = chunk.rstrip(_MARKS)
        if not word or word == chunk or not word.isalpha():
            return self._word(chunk, space)
        tail = chunk[len(word):]
        if tail not in self.marks:
            self.marks[tail] = self._whole(tail)
        return (self[word] if space else self._word(word, "")) + self.marks[tail]

    def __missing__(self, chunk: str) -> bytes:
        v = self.older.get(chunk)
        if v is not None:
            self[chunk] = v
            return v
        head, line, tail = chunk.partition("\n")
        if line and head and tail and tail.isalpha() and not head[-1].isspace():
            v = self._marked(head, " ") + self._line() + self._word(tail, "")
        elif line:
            v = self._whole(" " + chunk)
        else:
            v = self._marked(chunk, " ")
        self[chunk] = v
        return v

    def _line(self) -> bytes:
        if "\n" not in self.marks:
            self.marks["\n"] = self._whole("\n")
        return self.marks["\n"]

    def _turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def ids(self, text: str) -> np.ndarray:
        self._turn()
        if _SPLITS_ALIKE.search(text):
            return np.frombuffer(self._whole(text), "<u4")
        first, *rest = text.split(" ")
        return np.frombuffer(self._whole(first) + b"".join(map(self.__getitem__, rest)), "<u4")

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """``ids`` of every text. Very long texts go one by one, so the arrays here stay within a few times a batch."""
        words = texts.to_pylist()
        alone = np.array([len(t) > LONG or _SPLITS_ALIKE.search(t) is not None for t in words], bool)
        together = iter(self._together(texts.filter(pa.array(~alone))))
        return [self.ids(t) if a else next(together) for t, a in zip(words, alone)]

    def _together(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        code, different = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = bounds[:-1]  # a text's first stretch has no space before it
        heads = [self._whole(different[c]) for c in code[first]]
        code[first] = np.arange(len(heads)) + len(different)
        used = np.zeros(len(different) + len(heads), bool)
        used[code] = True
        parts: list[bytes] = []
        for k in range(0, len(different), 100_000):
            self._turn()
            parts += [self[w] if u else b"" for w, u in zip(different[k:k + 100_000], used[k:].tolist())]
        parts += heads
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        n, known = size[code], np.frombuffer(b"".join(parts), "<u4")
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[code] - (ends - n), n)
        at += np.arange(ends[-1])
        cuts = np.append(0, ends)[bounds]
        out = known[at]
        return [out[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder_for(path: str) -> CachedEncoder:
    """The worker's encoder of a file, kept for its next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]
