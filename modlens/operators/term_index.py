"""Terms of a large lexicon in texts, by an inverted index of the terms' q-grams.

Searching a text for every term costs terms x text. Here each term is filed under one of its
q-grams, the one that the fewest terms hold; a text's q-grams fetch the terms filed under them, and
only those are searched. A term that a text holds has all its q-grams there, so none is missed. The
cost of a text follows its length and the terms that share a gram with it, not the lexicon.

Terms shorter than a q-gram are filed under themselves, as grams of their own length. The index is
one entry per term; it is sent to the tasks, as the lexicon is a parameter that the driver holds.
Empty terms are left out; a null text holds nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.functions.identity import Lexicon

Q = 4
SENT_BYTES = 32 << 20


class TermIndex:
    """Terms by their rarest gram."""

    def __init__(self, terms: Iterable[str], q: int = Q):
        self.q = q
        self.terms = sorted({t for t in terms if t})
        often = Counter(g for t in self.terms for g in self._grams(t))
        self.filed: dict[str, list[str]] = {}
        for t in self.terms:
            # Of equally rare grams the smallest, so that the index is the same everywhere.
            rarest = min(self._grams(t), key=lambda g: (often[g], g))
            self.filed.setdefault(rarest, []).append(t)
        self.sizes = sorted({len(g) for g in self.filed})

    def _grams(self, term: str) -> set[str]:
        n = min(self.q, len(term))
        return {term[i : i + n] for i in range(len(term) - n + 1)}

    def candidates(self, text: str) -> list[str]:
        """The terms filed under a gram of the text."""
        found = []
        for n in self.sizes:
            grams = {text[i : i + n] for i in range(len(text) - n + 1)}
            for g in grams & self.filed.keys() if len(grams) > len(self.filed) else [g for g in grams if g in self.filed]:
                if len(g) == n:
                    found += self.filed[g]
        return found

    def held(self, text: str | None) -> list[str]:
        """The terms that stand in the text, in order."""
        return sorted(t for t in self.candidates(text) if t in text) if text else []


def held_terms(df: DataFrame, text_col: str, terms: Iterable[str], keep: Sequence[str], counts: bool = False) -> DataFrame:
    """A row per text and term that it holds: ``keep``, term, and with ``counts`` how often (n).

    Occurrences are counted from left to right without overlaps. Rows stay where they are.
    """
    shared = df.sparkSession.sparkContext.broadcast(TermIndex(terms))

    def run(batches) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            at, found, n = [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                own = index.held(text)
                at += [i] * len(own)
                found += own
                if counts:
                    n += [text.count(t) for t in own]
            rows = batch.select(list(keep)).take(pa.array(at, pa.int32()))
            columns = [*rows.columns, pa.array(found, pa.string())]
            names = [*keep, "term"]
            if counts:
                columns.append(pa.array(n, pa.int64()))
                names.append("n")
            yield pa.RecordBatch.from_arrays(columns, names)

    given = df.select(*keep, F.col(text_col).alias("_text"))
    schema = given.select(*keep).schema.add("term", "string")
    return given.mapInArrow(run, schema.add("n", "long") if counts else schema)


def categories(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows with a term once for each category that lists it; up to some size the lexicon is sent to the rows."""
    rows = [(c, t) for c, terms in lexicon.items() for t in dict.fromkeys(terms)]
    listed = df.sparkSession.createDataFrame(rows, "category string, term string")
    size = sum(len(c) + len(t) + 32 for c, t in rows)
    return df.join(F.broadcast(listed) if size <= SENT_BYTES else listed, "term")
