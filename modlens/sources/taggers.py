"""Tagged tokens from a tagger the user brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.functions.features import TAGGED_TYPE

# For a batch of texts, per text a list of (i, text, pos, head, sent).
_FIELDS = [
    pa.field("i", pa.int32()), pa.field("text", pa.string()), pa.field("pos", pa.string()),
    pa.field("head", pa.int32()), pa.field("sent", pa.int32()),
]
Tagger = Callable[[list[str]], list[list[tuple[int, str, str, int, int]]]]


def tag_texts(
    df: DataFrame,
    load_tagger: Callable[[], Tagger],
    text_col: str = "text",
    key: str = "doc_id",
    batch_size: int = 1000,
) -> DataFrame:
    """Key and ``tagged``: the tagger is loaded once per task and called per batch of texts.

    Blank and NULL texts have no tokens and do not reach the tagger.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = load_tagger()
        for part in parts:
            for at in range(0, part.num_rows, batch_size):
                rows = part.slice(at, batch_size)
                texts = ["" if t is None else t for t in rows.column("_t").to_pylist()]
                full = [n for n, t in enumerate(texts) if t.strip()]
                sizes = [0] * len(texts)
                # Fields of all tokens one after another, as Arrow keeps them.
                fields: list[list] = [[] for _ in _FIELDS]
                found = tagger([texts[n] for n in full]) if full else []
                for n, toks in zip(full, found):
                    sizes[n] = len(toks)
                    for values, more in zip(fields, zip(*toks)):
                        values += more
                tokens = pa.StructArray.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(fields, _FIELDS)], fields=_FIELDS
                )
                ends = pa.array([0, *accumulate(sizes)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("_k"), pa.ListArray.from_arrays(ends, tokens)], ["_k", "tagged"]
                )

    key_type = df.schema[key].dataType.simpleString()
    pairs = df.select(F.col(key).alias("_k"), F.col(text_col).alias("_t"))
    out = pairs.mapInArrow(run, f"_k {key_type}, tagged {TAGGED_TYPE}")
    return out.withColumnRenamed("_k", key)
