"""Token ids of whole texts by a given tokenizer file, with the ids of known words kept.

A tokenizer that never joins text across the start of a run of white space gives a text the ids of
its words, one after the other. Each Python worker therefore keeps the ids of the words it has
seen, up to a bound, and asks the tokenizer for new words only. Texts whose white space is unusual,
or that may hold a special token, go through the tokenizer as they are. A tokenizer file is tried
on a set of probe texts when it is loaded; where words alone give other ids than whole texts do,
all its texts go through it whole.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Sequence
from itertools import chain

import numpy as np

# Words kept per Python worker before the store starts anew.
MOST_WORDS = 800_000
# Capitals, contractions, digits, signs, accents, other scripts, and blanks of several kinds.
PROBES = [
    "Plain words, in A sentence. It's DON'T we'll x's", "a b\nc d\n\ne", "Ab12 3,4 (x) [y] {z} -- ... !?", "\nfirst",
    "caf\u00e9 e\u0301 \u03a3\u0391\u03a3. \u0130 \u65e5\u672c\u8a9e \U0001f600x", "tab\tin word\x0bq", "n\0l \0 word",
    "under_score snake_Case http://a.b/c?d=e", "word. word, Word., WORD.", "\u00a0x y\u2003z", "2nd 10th x1 1x", "I",
]


class _Index(dict):
    """Word to number; a word that is missing is learned."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word):
        n = self[word] = self.learn(word)
        return n


class WordIds:
    """Ids of texts; ``spaced`` says whether white space is part of the ids."""

    def __init__(self, path: str, spaced: bool, most: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced, self.most = spaced, most
        self._empty()
        self.by_words = True
        ids, ends = self.encode(PROBES)
        self.by_words = [o.tolist() for o in np.split(ids, ends[:-1])] == self.whole(PROBES)
        self._empty()

    def _empty(self) -> None:
        self.index = _Index(self._learn)
        self.start = array("q", [0])
        self.ids = array("I")

    def whole(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids straight from the tokenizer."""
        return [e.ids for e in self.tokenizer.encode_batch(list(texts), add_special_tokens=False)]

    def _words(self, text: str) -> list:
        if self.spaced:
            words = text.replace("\n", " \n").split(" ")
            # No blank stands before the first word, so it is kept apart from the same word elsewhere.
            words[0] = (words[0],)
            return words
        raw = text.encode()
        # Special tokens are found before capitals are lowered.
        return [None] if b"<|" in raw else raw.lower().split()

    def _spelled(self, word) -> str | None:
        # The text a word stands for; None where the words around it would matter.
        if word is None:
            return None
        if not self.spaced:
            return word.decode()
        if isinstance(word, tuple):
            return None if word[0][-1:].isspace() else word[0]
        if not word or word[-1].isspace():
            return None
        return word if word[0] == "\n" else " " + word

    def _put(self, ids) -> int:
        self.ids.extend(ids)
        self.start.append(len(self.ids))
        return len(self.start) - 2

    def _learn(self, word) -> int:
        core = word.rstrip(".," if self.spaced else b".,") if isinstance(word, (str, bytes)) else ""
        if core.isascii() and core.isalpha():
            # Letters and the signs behind them never share a token.
            if len(core) < len(word):
                at, tail = self.index[core], word[len(core):]
                ids = self.ids[self.start[at] : self.start[at + 1]]
                ids.extend(self._tail(tail if self.spaced else tail.decode()))
                return self._put(ids)
            # A word of ASCII letters is one unit for the tokenizer's model; the blank before it
            # is the letter that byte-level vocabularies write for a blank.
            unit = "\u0120" + core if self.spaced else core.decode()
            return self._put([t.id for t in self.model.tokenize(unit)])
        spelled = self._spelled(word)
        if spelled is None:
            return -1
        return self._put(self.tokenizer.encode(spelled, add_special_tokens=False).ids)

    @functools.lru_cache(1000)
    def _tail(self, tail: str) -> list[int]:
        return self.whole([tail])[0]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and the end of each text's ids."""
        if not self.by_words:
            got = [np.array(i, np.uint32) for i in self.whole(texts)]
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.cumsum([len(g) for g in got], dtype=np.int64)
        if len(self.index) > self.most:
            self._empty()
        split = [self._words(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = map(self.index.__getitem__, chain.from_iterable(split))
        at = np.fromiter(words, np.int64, int(counts.sum()))
        odd = np.unique(np.repeat(np.arange(len(texts)), counts)[at < 0]) if (at < 0).any() else ()
        if len(odd):
            return self._mixed(texts, set(odd.tolist()))
        return self._gather(at, counts)

    def _gather(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.ids, np.uint32)
        first, size = start[at], start[at + 1] - start[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total) + np.repeat(first - (ends - size), size)]
        words = np.cumsum(counts)
        doc_ends = np.concatenate([[0], ends])[words]
        return ids, doc_ends

    def _mixed(self, texts: Sequence[str], odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        plain = [i for i in range(len(texts)) if i not in odd]
        ids, ends = self.encode([texts[i] for i in plain]) if plain else (np.zeros(0, np.uint32), [])
        parts: list = [None] * len(texts)
        last = 0
        for i, e in zip(plain, ends):
            parts[i], last = ids[last:e], e
        for i, got in zip(sorted(odd), self.whole([texts[i] for i in sorted(odd)])):
            parts[i] = np.array(got, np.uint32)
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])


@functools.cache
def word_ids(path: str, spaced: bool) -> WordIds:
    """The worker's store for a tokenizer file."""
    return WordIds(path, spaced)
