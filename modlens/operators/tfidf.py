"""TF-IDF over word n-grams with a bounded vocabulary."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions import text as tx
from modlens.functions.arrays import let, string_array
from modlens.operators.frequent import first_terms, slot_rows
from modlens.operators.term_batches import Vocabulary, slot_counter, steps, term_counter

_WEIGHTS = pa.struct([("indices", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))])


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents; combining marks dropped."""
    pairs = {}
    for code in range(0xC0, 0x250):
        base = "".join(
            c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base

    def cut(t: Column) -> Column:
        plain = F.translate(t, "".join(pairs), "".join(pairs.values()))
        # ASCII, as many characters as bytes, has neither; the search would look up every character.
        return F.when(F.octet_length(t) == F.char_length(t), t).otherwise(
            F.regexp_replace(plain, r"[̀-ͯ]+", "")
        )

    return let(text, cut)


def _base(text: Column) -> Column:
    return strip_accents(F.lower(text))


def terms(text: Column, low: int = 1, high: int = 2) -> Column:
    """n-grams of the lower-cased words of two or more characters."""
    return tx.ngrams(F.regexp_extract_all(_base(text), F.lit(f"{tx.WORD}{{2,}}"), F.lit(0)), low, high)


def vocabulary(df: DataFrame, text_col: str = "text", max_features: int = 10_000) -> DataFrame:
    """The most frequent terms: term, total, df; ties by term.

    The texts are read twice: for sums of hash slots, then for exact counts of the terms that can be
    among the first. Hand in written ones.
    """
    texts = df.select(_base(F.col(text_col)).alias("t"))
    slots = slot_rows(max_features)

    def counted(sums: DataFrame, floor: int) -> DataFrame:
        heavy = None
        if floor:
            # At most 2 x slots bits, which the number of terms asked for bounds.
            marks = np.zeros(2 * slots, bool)
            marks[[r["slot"] for r in sums.filter(F.col("total") >= floor).collect()]] = True
            heavy = np.packbits(marks).tobytes()
        parts = texts.mapInArrow(term_counter(slots, heavy), "term string, total long, df long")
        return parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))

    sums = texts.mapInArrow(slot_counter(slots), "slot long, total long")
    return first_terms(
        max_features, slots, sums.groupBy("slot").agg(F.sum("total").alias("total")), counted
    )


@dataclass(frozen=True)
class TfidfModel:
    """Alphabetical vocabulary with its inverse document frequencies."""

    vocabulary: list[str]
    idf: list[float]

    def weights(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """The frame with ``indices`` and ``weights``: (1 + ln tf) x idf, rows of length 1.

        No shuffle: terms are looked up in the vocabulary, which travels with the task.
        """
        made = Vocabulary(self.vocabulary, self.idf)

        @F.arrow_udf("indices array<int>, weights array<double>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                parts = []
                for texts in steps(batch):
                    doc, term, weight = made.weights(texts)
                    ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
                    at = pa.array(np.concatenate([[0], ends]), pa.int32())
                    lists = [
                        pa.ListArray.from_arrays(at, v) for v in (pa.array(term, pa.int32()), pa.array(weight))
                    ]
                    parts.append(pa.StructArray.from_arrays(lists, ["indices", "weights"]))
                yield pa.concat_arrays(parts) if parts else pa.array([], _WEIGHTS)

        out = df.withColumn("_s", run(_base(F.col(text_col))))
        return out.select(*[F.col(c) for c in df.columns], "_s.indices", "_s.weights")

    def long(self, df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
        """One row per document and term: key, term, weight."""
        names = string_array(self.vocabulary)
        pair = F.explode(F.arrays_zip("indices", "weights")).alias("p")
        return (
            self.weights(df.select(key, text_col), text_col)
            .select(key, pair)
            .select(key, F.get(names, F.col("p.indices")).alias("term"), F.col("p.weights").alias("weight"))
        )

    def heaviest(self, df: DataFrame, width: int, text_col: str = "text") -> list[int]:
        """Numbers of the ``width`` terms with the greatest sum of weights; ties in term order."""
        pair = F.explode(F.arrays_zip("indices", "weights")).alias("p")
        sums = self.weights(df.select(text_col), text_col).select(pair).groupBy("p.indices").agg(
            # Rounded, so that the order does not hang on the order of the sum.
            F.round(F.sum("p.weights"), 6).alias("total")
        )
        top = sums.orderBy(F.col("total").desc(), "indices").limit(width)
        return [r["indices"] for r in top.collect()]

    def block(
        self, df: DataFrame, width: int = 100, text_col: str = "text", by: str = "term"
    ) -> DataFrame:
        """The frame with columns ``tfidf_0`` … of fixed terms.

        ``by="term"`` takes the first terms of the alphabet, ``by="idf"`` the rarest ones first,
        ``by="weight"`` those with the greatest sum of weights over the frame (one pass more).
        """
        chosen = list(range(min(width, len(self.vocabulary))))
        if by == "weight":
            chosen = self.heaviest(df, width, text_col)
        if by == "idf":
            ranked = sorted(range(len(self.idf)), key=lambda i: (-self.idf[i], self.vocabulary[i]))
            chosen = ranked[: len(chosen)]
        made, n = Vocabulary(self.vocabulary, self.idf), max(len(self.idf), 1)
        place = np.full(n, -1)
        place[chosen] = np.arange(len(chosen))

        @F.arrow_udf("array<double>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                rows = [np.zeros((0, width))]
                for texts in steps(batch):
                    doc, term, weight = made.weights(texts)
                    rows.append(np.zeros((len(texts), width)))
                    kept = place[term] >= 0
                    rows[-1][doc[kept], place[term[kept]]] = weight[kept]
                cells = np.concatenate(rows)
                at = pa.array(np.arange(len(cells) + 1) * width, pa.int32())
                yield pa.ListArray.from_arrays(at, pa.array(cells.ravel()))

        table = df.withColumn("_row", run(_base(F.col(text_col))))
        return table.withColumns({f"tfidf_{i}": F.get("_row", F.lit(i)) for i in range(width)}).drop("_row")


def fit_tfidf(df: DataFrame, text_col: str = "text", max_features: int = 10_000) -> TfidfModel:
    """Fit the vocabulary and its idf = ln((1 + n) / (1 + df)) + 1.

    The driver holds ``max_features`` terms at most.
    """
    n = F.lit(df.select(F.count("*").alias("n")).first()["n"]).cast("double")
    rows = (
        vocabulary(df, text_col, max_features)
        .select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
        .orderBy("term")
        .collect()
    )
    return TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows])
