"""Lexical search, resampling and the quality model against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from modlens.llm import lexical, quality_model, resampling
from modlens.llm.registry import QUERIES
from modlens.llm.words import WORD, raw_texts, slices, split_words
from cases import empty, frame, odd, odd_rows, prose  # noqa: F401

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return re.findall(WORD, (text or "").translate(ASCII_LOWER))


# -- words ------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    rng = np.random.default_rng(2)
    letters = list("aZ09_-.,'\"\t\n\0\x7f é日😀 `{[@/:")
    for _ in range(500):
        text = "".join(rng.choice(letters, rng.integers(0, 30)).tolist())
        assert [w.decode() for w in split_words(text.encode())] == plain_words(text)


def test_slices_hold_every_row_once():
    texts = ["x" * 50, None, "", "y" * 900, "z" * 30] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [raw_texts(p.column("text")) for p in slices(batch, 7, 1000)]
    assert [t.decode() for p in parts for t in p] == [t or "" for t in texts]
    assert all(len(p) <= 7 and (len(p) == 1 or sum(map(len, p)) <= 1000) for p in parts)


# -- lexical search ---------------------------------------------------------------------


def plain_search(docs, items, k=50):
    """(item, rank, doc, score) by the formula, one document after the other."""
    own = [(d, Counter(plain_words(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, n_words = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(plain_words(t))
    out = []
    for i, asked in terms.items():
        rows = []
        for d, c, n in own:
            m = 100 - 50 + (50 * n * n_docs) // n_words
            score = 0
            for t in asked & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def some_items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, score string, rank int")


ITEMS = [
    (1, prose(1, 12)), (2, "ONE two and"), (3, None), (4, ""), (5, "..."), (1, "blanks É"), (7, prose(15, 30)), (None, "line tab"),
    (8, "nowhere"), (9, prose(3, 5) + " " + prose(7, 5)),
]


@pytest.mark.parametrize("bounds", [{}, {"block_postings": 40, "visit": 8}, {"item_bytes": 60, "k": 3}, {"block_postings": 1, "k": 2}])
def test_search_on_odd_rows(spark, odd, bounds):
    s = lexical.SearchSettings(**bounds)
    got = lexical.search(odd, some_items(spark, ITEMS), s)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain_search([(d, t) for d, t, _, _ in odd_rows()], ITEMS, s.k)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_of_ties_and_of_many_documents(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 200), "en", "a") for i in range(1500)]
    rows += [(2000 + i, rows[7][1], "en", "a") for i in range(120)]
    docs, items = frame(spark, rows).repartition(5), [(i, f"w1 w{i} W{3 * i}") for i in range(12)]
    want = plain_search([(r[0], r[1]) for r in rows], items)
    for bounds in ({}, {"block_postings": 900, "visit": 64}):
        got = lexical.search(docs, some_items(spark, items), lexical.SearchSettings(**bounds))
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_shares_of_tasks_meet_in_two_steps(spark):
    rows = [(i % 3, i, (i * 37) % 101) for i in range(900)]
    found = spark.createDataFrame(rows, lexical.FOUND)
    s = lexical.SearchSettings(k=7)
    one, two = (sorted(map(tuple, lexical.meet(found, n, s).collect())) for n in (10, 50_000_000))
    assert one == two and len(one) == 21


def test_bounds_leave_strata_unvisited():
    rng = np.random.default_rng(4)
    n = np.sort(rng.integers(5, 4000, 3000))
    counts = np.full(3000, 2)
    terms = np.tile([0, 1], 3000).astype(np.int32)
    tfs = np.where(np.arange(6000) % 2 == 0, 1, rng.integers(1, 4, 6000)).astype(np.int32)
    s = lexical.SearchSettings(k=10, visit=64)
    block = lexical.Block(np.arange(3000), n, counts, terms, tfs, np.array([100, 900]), 3000, int(n.sum()), s)
    top, scored = block.search(np.array([0, 1]), [], s)
    assert len(top) == 10 and scored < 1000
    everything, all_of_them = block.search(np.array([0, 1]), [], lexical.SearchSettings(k=10, visit=1 << 20))
    assert everything == top


def test_search_of_nothing(spark, odd, empty):
    assert lexical.search(empty, some_items(spark, ITEMS)).count() == 0
    assert lexical.search(odd, some_items(spark, [])).count() == 0
    assert lexical.search(odd, some_items(spark, [(1, "..."), (2, None)])).count() == 0


# -- resampling -------------------------------------------------------------------------


def plain_draw(docs, target, buckets=10_000):
    def runs(text):
        w = plain_words(text)
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    corpus, aim = Counter(), Counter()
    own = [(d, *runs(t)) for d, t in docs]
    for _, _, f in own:
        corpus.update(f)
    for t in target:
        aim.update(runs(t)[1])
    big, small = sum(corpus.values()) + buckets, sum(aim.values()) + buckets
    gain = [math.floor(1000 * math.log(((aim[b] + 1.0) * big) / ((corpus[b] + 1.0) * small))) for b in range(buckets)]
    out = []
    for d, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    return out, able[: 25 * len(able) // 100]


@pytest.mark.parametrize("target", [[prose(1, 30), None, "ONE two"], []])
def test_draw_on_odd_rows(spark, odd, target):
    items = some_items(spark, list(enumerate(target)))
    got = resampling.draw(odd, items)
    plain, drawn = plain_draw([(d, t) for d, t, _, _ in odd_rows()], target)
    rows = [tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score")) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(plain, key=str)
    ranks = {r["rank"]: (r["doc_id"], r["score"]) for r in got.collect() if r["rank"] is not None}
    assert ranks == {n + 1: (r[0], r[4]) for n, r in enumerate(drawn)}


def test_draw_of_many_rows_and_ties(spark):
    rows = [(i % 400, prose(i % 90, 15 + i % 20), "en", "a") for i in range(1200)]
    got = resampling.draw(frame(spark, rows).repartition(6), some_items(spark, [(1, prose(5, 200))])).collect()
    plain, drawn = plain_draw([(r[0], r[1]) for r in rows], [prose(5, 200)])
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(drawn) + 1))
    by = {r["rank"]: (r["doc_id"], r["weight"], r["score"]) for r in got if r["rank"] is not None}
    assert [by[n + 1] for n in range(len(drawn))] == [(r[0], r[3], r[4]) for r in drawn]
    assert len(got) == len(plain)


def test_draw_of_nothing(spark, empty):
    assert resampling.draw(empty, some_items(spark, ITEMS)).count() == 0


def test_checksums_by_columns():
    rng = np.random.default_rng(1)
    feats = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in [0, 1, 1, 2, 5, 5, 5, 40, 512, 513, 5000]]
    order = rng.permutation(len(feats))
    feats = [feats[i] for i in order]
    got = resampling.checksums(np.frombuffer(b"".join(feats), np.uint8), np.array([len(f) for f in feats]))
    assert got.tolist() == [zlib.crc32(f) for f in feats]


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_features_stay_inside_their_text(runs):
    s = resampling.DrawSettings(runs=runs)
    texts = ["a b c a b", "", "c a", "a", "b c a b c", "É x", "q" * 600 + " z"]
    bucket, owner, n = resampling.features([t.encode() for t in texts], s)
    for i, t in enumerate(texts):
        w = plain_words(t)
        want = [" ".join(w[j : j + k]) for k in range(1, runs + 1) for j in range(len(w) - k + 1)]
        assert Counter(bucket[owner == i].tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in want)
        assert n[i] == len(w)


# -- quality model ----------------------------------------------------------------------


def test_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality_model.Machine(0.3, rng.normal(size=(50, 5)))
    rows = [np.sort(rng.choice(50, n, replace=False)) for n in (3, 7, 1)]
    values = [rng.normal(size=len(r)) for r in rows]
    got, _ = m.raw(np.concatenate(rows), np.concatenate(values), np.repeat(np.arange(3), [3, 7, 1]), 3)
    for raw, at, x in zip(got, rows, values):
        pairs = sum(
            m.table[at[i], 1:] @ m.table[at[j], 1:] * x[i] * x[j] for i in range(len(at)) for j in range(i + 1, len(at))
        )
        assert np.isclose(raw, 0.3 + m.table[at, 0] @ x + pairs)


def test_steps_follow_the_gradient():
    s = quality_model.QualityModelSettings(steps=1, batch=20, shrink=0.0)
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(s.places, 6, replace=False)), np.ones(6), int(i % 2), 1.0) for i in range(20)]
    start = quality_model.Machine(0.0, rng.normal(0, 0.3, (s.places, 3)))

    def loss(m):
        raws = [float(m.raw(a, v, np.zeros(len(a), int), 1)[0][0]) for a, v, _, _ in rows]
        return sum(np.log1p(np.exp(-r if y else r)) for r, (_, _, y, _) in zip(raws, rows)) / len(rows)

    past = np.zeros_like(start.table)
    got, seen = quality_model.follow(start, past, rows, s, 1)
    place, eps = int(rows[0][0][0]), 1e-6
    for c in range(3):
        moved = quality_model.Machine(0.0, start.table.copy())
        moved.table[place, c] += eps
        slope = (loss(moved) - loss(start)) / eps
        # One step divides the gradient by its size, so the past holds its square.
        assert np.isclose(np.sqrt(seen[place, c]), abs(slope), atol=1e-5)
        assert np.sign(start.table[place, c] - got.table[place, c]) == np.sign(slope)
    assert loss(got) < loss(start)


def out_of_learning(key):
    return zlib.crc32(str(key).encode()) % 4 == 2


def graded(n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, 60)
        if bad:
            text = " ".join(w + "###" for w in text.split()) if i % 8 else text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", "a"))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_of_planted_texts(spark):
    rows, labels = graded()
    docs = frame(spark, rows + rows[:20])
    known = spark.createDataFrame(labels + labels[:30] + [(None, 1, 0), (9999, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(docs, known)
    got = quality_model.scored(docs, model).collect()
    assert len(got) == len(rows) + 20
    held = [r for r in got if out_of_learning(r["doc_id"])]
    right = sum((r["score"] >= 0.7) == (r["doc_id"] % 4 != 0) for r in held)
    assert len(held) > 60 and right >= 0.95 * len(held)
    # Language, source and key do not matter.
    other = frame(spark, [(d + 100_000, t, "xx", "zz") for d, t, _, _ in rows])
    again = {r["doc_id"] - 100_000: r["score"] for r in quality_model.scored(other, model).collect()}
    assert all(np.isclose(r["score"], again[r["doc_id"]]) for r in got)


def test_quality_of_odd_rows(spark, odd, empty):
    schema = "doc_id long, quality int, toxic int"
    none = quality_model.train(odd, spark.createDataFrame([], schema))
    assert {r["score"] for r in quality_model.scored(odd, none).collect()} == {0.0}
    one = quality_model.train(odd, spark.createDataFrame([(5, 1, 1), (3, 1, 1)], schema))
    assert {r["score"] for r in quality_model.scored(odd, one).collect()} == {1.0}
    both = [(d, d % 2, 0) for d in range(21)] + [(4, 1, 0), (20, 1, 0)]
    model = quality_model.train(odd, spark.createDataFrame(both, schema))
    got = quality_model.scored(odd, model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_model.scored(empty, model).count() == 0
    assert quality_model.scored(odd.drop("n_chars"), model).count() == len(odd_rows())
    same = {r["doc_id"]: r["score"] for r in quality_model.scored(odd, quality_model.train(odd, spark.createDataFrame(both, schema))).collect()}
    assert all(same[r["doc_id"]] == r["score"] for r in got)


def test_quality_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op11_quality_model"].run(spark, folder).collect()
    truth = dict(duckdb.sql(f"select doc_id, min(quality) from '{folder}/labels.parquet' group by 1").fetchall())
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == out_of_learning(r["doc_id"]) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
