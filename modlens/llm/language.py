"""Language identification by cross-parsing against suffix automata of labelled text.

A bounded sample of labelled text per language becomes a suffix automaton: the states that say how
far a text goes on matching some place of the sample. A text is parsed into longest matches; where
no match can go on, a phrase ends and the next begins. The language whose sample needs the fewest
phrases, each counted with the bits that point into the sample, wins.

Every text is parsed whole, in stretches of ``STRETCH`` characters that all languages see alike. A
task parses all stretches of a batch at once, one character a step. Every letter of the samples has
a symbol. The transitions by the most frequent letters are laid out as one table, those by the others
as sorted keys; the size of both is bounded by the sample and the number of languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when
no language can be learned. Of equally good languages the first by name wins. Repeated rows are
judged alike. A language with little labelled text has a smaller sample. An empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import held_out, table
from modlens.operators.ranking import top_k_per

STRETCH = 512
LETTERS = 60  # letters with a column in the transition table; those of the others are searched
GAP, OTHER, PAD = 0, 1, 2
BATCH = 1000


@dataclass(frozen=True)
class LanguageSettings:
    """The bounded sample of labelled text: documents per language, characters of each and in all.

    More than ``languages`` labels stop the job: each takes a sample and an automaton of bounded size.
    """

    sample_docs: int = 240
    doc_chars: int = 400
    sample_chars: int = 30_000
    languages: int = 1000


@functools.cache
def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts in a row, and the number of each text."""
    low = [t.lower() for t in texts]
    flat = "".join(low).encode("utf-32-le", "surrogatepass")
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    return np.frombuffer(flat, np.uint32), np.repeat(np.arange(len(low)), sizes)


def symbols(points: np.ndarray, owner: np.ndarray, symbol_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a row of texts: letters, and one gap for whatever stands between them."""
    out = symbol_of[points]
    again = np.zeros(len(out), bool)
    again[1:] = (out[1:] == GAP) & (out[:-1] == GAP) & (owner[1:] == owner[:-1])
    return out[~again], owner[~again]


class SuffixAutomaton:
    """States and transitions of all substrings of a row of symbols, built symbol by symbol."""

    def __init__(self, row: np.ndarray):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in row.tolist():
            last = self._extend(last, c)

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        new = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
        return new


@dataclass
class Parser:
    """The automata as one table; ``table[state + symbol]`` is 2 x next state, +1 where a phrase began.

    Symbols from ``width`` on are not in the table: of ``rare_keys`` (state x number of symbols + symbol, in
    order) ``rare_moves`` has 2 x next state. OTHER stands for letters that no sample holds.
    """

    names: list[str]
    symbol_of: np.ndarray
    table: np.ndarray
    start: np.ndarray
    bits: np.ndarray
    width: int
    n_symbols: int
    roots: np.ndarray
    rare_keys: np.ndarray
    rare_moves: np.ndarray

    def _known(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        # Moves by symbols that are not in the table; -1 where there is none.
        key = state.astype(np.int64) * self.n_symbols + symbol
        spot = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
        return np.where(self.rare_keys[spot] == key, self.rare_moves[spot], -1)

    def _rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        # The moves of all languages (rows) by symbols that are not in the table.
        move = self._known(state, symbol)
        ends = move < 0
        begin = self._known(np.broadcast_to(self.roots[:, None], state.shape)[ends], np.broadcast_to(symbol, state.shape)[ends])
        move[ends] = np.where(begin >= 0, begin, np.broadcast_to(self.start[:, None] * 2, state.shape)[ends]) + 1
        return move

    def phrases(self, row: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Phrases per text (n) and language of a row of symbols."""
        out = np.zeros((n, len(self.names)))
        if not len(row):
            return out
        first = np.searchsorted(owner, np.arange(n))
        place = np.arange(len(row)) - first[owner]
        lane_key = owner * (int(place.max()) // STRETCH + 1) + place // STRETCH
        starts = np.flatnonzero(np.r_[True, lane_key[1:] != lane_key[:-1]])
        sizes = np.diff(np.r_[starts, len(row)])
        # Long stretches first, so that each step works on the lanes that still have a symbol.
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        state = np.repeat(self.start[:, None], len(starts), 1)
        count = np.zeros(state.shape, np.int32)
        has_rare = int(row.max()) >= self.width
        for step in range(int(sizes[0])):
            k = live[step]
            symbol = row[starts[:k] + step]
            rare = np.flatnonzero(symbol >= self.width) if has_rare else ()
            if len(rare):
                move = self.table[state[:, :k] + np.where(symbol < self.width, symbol, GAP)]
                move[:, rare] = self._rare(state[:, rare], symbol[rare].astype(np.int64))
            else:
                move = self.table[state[:, :k] + symbol]
            count[:, :k] += move & 1
            state[:, :k] = move >> 1
        np.add.at(out, owner[starts], count.T)
        return out


def learn(samples: dict[str, list[str]], s: LanguageSettings) -> Parser:
    """Automata of the sampled texts of each language."""
    names = sorted(samples)
    points, _ = code_points([" ".join(samples[n]) for n in names])
    is_letter = letter_table()
    found, counts = np.unique(points[is_letter[points]], return_counts=True)
    own = found[np.lexsort((found, -counts))]
    symbol_of = np.where(is_letter, OTHER, GAP).astype(np.int64)
    symbol_of[own] = np.arange(len(own)) + PAD + 1
    n_symbols = len(own) + PAD + 1
    width = min(n_symbols, LETTERS + PAD + 1)
    rows, begins, roots, bits, at = [], [], [], [], 0
    rare: list[tuple[int, int]] = []
    for name in names:
        points, owner = code_points([" ".join(samples[name])])
        row = symbols(points, owner, symbol_of)[0][: s.sample_chars]
        auto = SuffixAutomaton(row)
        moves = np.full((len(auto.next) + 1, width), -1, np.int64)
        for state, out in enumerate(auto.next):
            for c, to in out.items():
                if c < width:
                    moves[state, c] = (at + to * width) * 2
                else:
                    rare.append(((at + state * width) * n_symbols + c, (at + to * width) * 2))
        # Where no match goes on, a phrase ends and the symbol begins the next one; a symbol that
        # the sample lacks is a phrase alone, after which nothing goes on.
        alone = at + (len(moves) - 1) * width
        begin = np.where(moves[0] >= 0, moves[0], alone * 2) + 1
        rows.append(np.where(moves >= 0, moves, begin[None, :]).ravel())
        begins.append(alone)
        roots.append(at)
        bits.append(np.log2(max(2, len(row))))
        at += moves.size
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    small = np.int32 if 2 * at < 2**31 else np.int64
    keys, to = np.array(sorted(rare), np.int64).reshape(-1, 2).T
    kind = np.uint8 if n_symbols <= 256 else np.uint16 if n_symbols <= 65536 else np.int32
    return Parser(
        names, symbol_of.astype(kind), flat.astype(small), np.array(begins, small), np.array(bits),
        width, n_symbols, np.array(roots, np.int64), keys.copy(), to.astype(small),
    )


def sample(docs: DataFrame, s: LanguageSettings) -> dict[str, list[str]]:
    """The bounded sample per language: the first documents by a hash of their key."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    spot = F.xxhash64("doc_id")
    # A piece from a place that the key decides, so that openings do not dominate.
    room = F.greatest(F.length("text") - s.doc_chars, F.lit(0)) + 1
    piece = F.substring("text", F.pmod(spot, room) + 1, s.doc_chars)
    rows = known.select("lang", spot.alias("spot"), piece.alias("piece"))
    kept = top_k_per(rows, ["lang"], [F.col("spot").asc(), F.col("piece").asc()], s.sample_docs)
    kept = kept.filter(F.col("piece") != "")
    out: dict[str, list[str]] = {}
    many = known.select("lang").distinct().count()
    if many > s.languages:
        raise ValueError(f"{many} languages are labelled; at most {s.languages} can be learned (languages=)")
    for r in kept.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["piece"])
    return out


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """doc_id, lang_pred and score of every row; whole texts, in place."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                pred, score = judge(p, [t or "" for t in part.column("text").to_pylist()])
                columns = [part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def judge(p: Parser, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Best language and its score (its share when each bit fewer halves a language's chance)."""
    points, owner = code_points(texts)
    n = len(texts)
    lettered = np.bincount(owner, letter_table()[points], n) > 0
    if not p.names:
        return ["und"] * n, np.zeros(n)
    row, owner = symbols(points, owner, p.symbol_of)
    bits = p.phrases(row, owner, n) * p.bits
    best = bits.argmin(1)
    gap = (bits - bits.min(1, keepdims=True)) / 8
    score = np.where(lettered, 1 / np.exp2(-np.minimum(gap, 1000)).sum(1), 0.0)
    return [p.names[b] if ok else "und" for b, ok in zip(best, lettered)], score


def op8(spark, folder):
    """Every document's language, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    s = LanguageSettings()
    found = identify(docs, learn(sample(docs, s), s))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
