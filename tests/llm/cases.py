import random
import zlib

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns of a caller's own, with names that operators use inside.
CLASHING = "key long, block int, rank int, kept string, recipe string, n long, component long, term string"


def frame(spark, rows, clash=True):
    """Documents (doc_id, text, lang, source) with n_chars and columns of clashing names."""
    full = [(d, t, la, so, len(t or "")) for d, t, la, so in rows]
    if not clash:
        return spark.createDataFrame(full, SCHEMA)
    own = (1, 2, 3, "x", "y", 4, 5, "z")
    return spark.createDataFrame([r + own for r in full], f"{SCHEMA}, {CLASHING}")


def prose(seed, words):
    """Made-up words."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abdeginorst", k=rng.randint(2, 7))) for _ in range(words))


def odd_rows():
    """Nulls, empty and short texts, copies, near copies, shared passages, ties and a long text."""
    base, passage = prose(1, 120), prose(2, 40)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [
        (5, base, "en", "a"), (3, base, "en", "a"), (9, near, "en", None), (2, None, "en", "a"),
        (4, "", None, "a"), (6, " \n\t ", "de", "a"), (7, "one two", "en", "b"), (8, "ONE  two", "en", "b"),
        (10, prose(3, 80) + "\n" + passage, "de", "b"), (11, passage + "\n" + prose(4, 90), "de", "b"),
        (12, "tab\tand  blanks \n\n <|endoftext|> é ½ 日本 \u2581 x", None, None),
        (13, "a" * 5000, "en", "a"), (14, "ab " * 3000, "en", "a"), (15, prose(5, 20000), "de", "b"),
        (16, base.replace(" ", "\n"), "en", "a"), (17, "line\nline\nline\n" + prose(6, 60), "en", "a"),
        (None, base, "en", "a"), (20, prose(7, 70), "en", "a"), (20, prose(7, 70), "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def texts(folder):
    """(doc_id, text) of the small documents, in order."""
    return duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet' order by doc_id").fetchall()


def crc(ids):
    """Unsigned crc32 of little-endian 32-bit ids."""
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
