"""Token ids as flat files of unsigned integers with 64-bit document offsets.

Documents are put into ascending key order over range partitions; each partition is encoded and
written by one task as one file through Spark's text sink, so the folder may be in any store and a
lost task is simply run again. A file holds, from its first byte on, the ids of its documents as
little-endian unsigned integers of ``width`` bytes (2 or 4; an id that does not fit stops the job),
each document closed by the end id; ``mapped`` maps that part into memory as it is. Behind the ids stands a
trailer of 64-bit integers: the keys, their presence (1, or 0 for a null key), the offsets of the
documents in the file's ids, and the number of documents; the end id closes the file. The first
offset of every file in the whole collection, its base, is the prefix sum over the files' sizes.
The number of files follows from the bytes of the texts, so that none grows with the table.

Defined cases: a null text counts as empty and has the end id alone. A null key sorts first. Rows
that share a key are ordered by a hash of their text; equal rows are all written. An empty table
gives no documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modlens.llm.common import table
from modlens.llm.tokens import word_ids
from modlens.session import run_dir

BATCH = 400  # texts encoded at a time
FILE_BYTES = 64 << 20  # of text that a file is made for


def vocabulary(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_batches(batches, path: str, spaced: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Small batches of rows with their ids and the end of each row's ids."""
    store = word_ids(path, spaced)
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            ids, ends = store.encode([t or "" for t in part.column("text").to_pylist()])
            yield part, ids, ends


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, spaced: bool, end_id: int, key: str = "doc_id", width: int = 2
) -> None:
    """Write the ids of all texts in ascending key order."""
    kind, most = f"<u{width}", 256**width - 1
    if end_id > most:
        raise ValueError(f"end id {end_id} does not fit into {width} bytes")

    def rows(batches):
        keys, known, lengths = [], [], []
        for part, ids, ends in encoded_batches(batches, tokenizer, spaced):
            if len(ids) and ids.max() > most:
                raise ValueError(f"token id {ids.max()} does not fit into {width} bytes")
            flat, last, out = ids.astype(kind), 0, []
            for end in ends:
                out.append(flat[last:end].tobytes())
                lengths.append(int(end - last) + 1)
                last = end
            for k in part.column("key").to_pylist():
                keys.append(k or 0)
                known.append(k is not None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if keys:
            offsets = np.cumsum([0, *lengths[:-1]])
            trailer = np.concatenate([keys, known, offsets, [len(keys)]]).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([trailer.tobytes()], pa.binary())], ["value"])

    ordered = docs.select(
        F.col(key).cast("long").alias("key"), "text", F.xxhash64("text").alias("tie")
    )
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(max(parts, -(-size // FILE_BYTES)), "key", "tie").sortWithinPartitions("key", "tie")
    files = ordered.select("key", "text").mapInArrow(rows, "value binary")
    end = end_id.to_bytes(width, "little").decode("latin-1")
    # The separator that the sink puts behind each row is the end id.
    files.select(F.col("value").cast("string")).write.option("lineSep", end).option(
        "encoding", "ISO-8859-1"
    ).text(folder)


def mapped(path: str, width: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A file in a local or mounted folder: its ids, mapped into memory, its keys and its offsets.

    Only the pages that a reader touches are loaded. Keys of null are masked.
    """
    raw = np.memmap(path, np.uint8, "r")
    n = int(raw[len(raw) - 8 - width : len(raw) - width].view("<i8")[0])
    at = len(raw) - width - 8 - 24 * n
    keys, known, offsets = np.array(raw[at : at + 24 * n]).view("<i8").reshape(3, n)
    return raw[:at].view(f"<u{width}"), np.ma.array(keys, mask=known == 0), offsets


def read_token_files(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """Per document of the files: key, start (ids before it), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").load(folder).filter(F.col("length") > 0)
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("part")
    # Number of documents and of ids of a file, from its trailer and its length.
    tail = F.substring("content", -8 - width, 8)
    docs = F.conv(F.concat(*[F.substring(F.hex(tail), 15 - 2 * i, 2) for i in range(8)]), 16, 10).cast("long")
    sizes = files.select(number, ((F.col("length") - width - 8 - 24 * docs) / width).cast("long").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kind = f"<u{width}"
    names = ["key", "start", "n_tokens", "ids_crc32"]

    def digests(batches):
        for batch in batches:
            for content, base in zip(batch.column("content"), batch.column("base").to_pylist()):
                raw = memoryview(content.as_buffer())
                n = int(np.frombuffer(raw[-8 - width : -width], "<i8")[0])
                at = len(raw) - width - 8 - 24 * n
                keys, known, offsets = np.frombuffer(raw[at : at + 24 * n], "<i8").reshape(3, n)
                ids = np.frombuffer(raw[:at], kind).astype("<u4")
                ends = np.append(offsets[1:], len(ids))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets, ends)]
                key = pa.array(keys, pa.int64(), mask=known == 0)
                columns = [key, pa.array(offsets + base), pa.array(ends - offsets), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    with_base = files.select("content", number).join(bases, "part").select("content", "base")
    return with_base.mapInArrow(digests, "key long, start long, n_tokens long, ids_crc32 long")


def op2(spark, folder):
    """All documents written as token files; digests of what the files hold."""
    path = run_dir(spark, "tokens")
    docs = table(spark, folder, "documents")
    write_token_files(docs, path, vocabulary("byte_bpe_50k.json"), spaced=True, end_id=2)
    return read_token_files(spark, path).withColumnRenamed("key", "doc_id")
