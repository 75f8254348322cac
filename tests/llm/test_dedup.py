"""The near-duplicate join and the removal of repeated passages against plain searches."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from modlens.llm import bwt, repeats, signature_join
from modlens.llm.components import components
from modlens.llm.registry import QUERIES
from cases import empty, frame, odd, odd_rows, prose, texts  # noqa: F401

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").encode().translate(LOW).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def plain_components(rows, percent=80):
    sets = {k: shingles(t) for k, t in rows}
    holders = defaultdict(list)
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, own in sets.items():
        for other, n in Counter(o for s in own for o in holders[s]).items():
            if 100 * n >= percent * (len(own) + len(sets[other]) - n):
                a, b = find(k), find(other)
                up[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(k)
    return sorted((k, len(s), find(k)) for k, s in sets.items())


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


def test_join_on_the_table(spark, folder, texts):
    assert rows_of(QUERIES["op1_signature_join"].run(spark, folder)) == plain_components(texts)


def clusters():
    """Chains and clouds of near copies around the bound, and documents made of common passages."""
    rng = np.random.default_rng(3)
    common = [prose(100 + i, 30) for i in range(4)]
    rows = []
    for c in range(6):
        words = prose(c, 90).split()
        for _ in range(9):
            own = list(words)
            for at in rng.choice(90, rng.integers(0, 5), replace=False):
                own[at] = f"x{rng.integers(10**6)}"
            rows.append(" ".join(own))
            words = own if rng.random() < 0.4 else words
    rows += [" ".join(rng.permutation(common)) for _ in range(12)]
    rows += [prose(500 + i, 6) for i in range(5)] + ["a b c d e", "a b c d e f", "A b c d", "a b c d"]
    return list(enumerate(rows))


@pytest.mark.parametrize("weight", [400_000, 1500])
def test_join_on_clusters(spark, weight):
    rows = clusters()
    df = frame(spark, [(k, t, "en", "a") for k, t in rows])
    s = signature_join.JoinSettings(block_weight=weight, leaf=3, bits=128)
    assert rows_of(signature_join.near_duplicates(df, s)) == plain_components(rows)


def test_join_on_odd_rows(odd):
    got = signature_join.near_duplicates(odd).collect()
    plain = plain_components([(k, t) for k, t, _, _ in odd_rows() if k is not None])
    assert {tuple(r) for r in got if r["doc_id"] is not None} == set(plain)
    assert len(got) == len(odd_rows())
    (null,) = [r for r in got if r["doc_id"] is None]
    assert null["component_id"] is None and null["n_shingles"] == 116
    kept = signature_join.first_of_groups(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _, c in plain if k == c} | {None}


def test_join_of_nothing(empty):
    assert signature_join.near_duplicates(empty).count() == 0


def test_tree_finds_every_link():
    rng = np.random.default_rng(1)
    s = signature_join.JoinSettings(leaf=4, bits=64)
    sets = [np.setdiff1d(np.arange(40), rng.integers(0, 44, rng.integers(1, 9))).astype(np.uint64) * 977 for _ in range(80)]
    up = np.arange(80)
    for x, y in signature_join.tree_links(sets, np.arange(80), s):
        up[up == up[y]] = up[x]
    plain = np.arange(80)
    for x in range(80):
        for y in range(x):
            n = len(np.intersect1d(sets[x], sets[y]))
            if 100 * n >= 80 * (len(sets[x]) + len(sets[y]) - n):
                plain[plain == plain[y]] = plain[x]
    same = lambda v: v[:, None] == v[None, :]
    assert (same(up) == same(plain)).all() and len(set(plain)) < 80


@pytest.mark.parametrize("per_task", [1_000_000, 5])
def test_components(spark, per_task):
    edges = [(1, 2), (2, 3), (9, 3), (5, 4), (7, 7)] + [(100 + i, 101 + i) for i in range(30)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), per_task).collect()}
    assert {(1, 1), (2, 1), (3, 1), (9, 1), (4, 4), (5, 4), (130, 100)} <= got and len(got) == 6 + 31


# -- repeated passages ----------------------------------------------------------------------


def plain_removal(rows, window=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by a dictionary of windows."""
    seen, out = set(), []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                gone[i : i + window] = True
            seen.add(raw[i : i + window])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removal(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_removal_on_the_table(spark, folder, texts):
    assert removal(QUERIES["op6_repeats"].run(spark, folder)) == plain_removal(texts)


@pytest.mark.parametrize("hot", [20_000, 2, 0])
@pytest.mark.parametrize("size", [4_000_000, 2_000])
def test_removal_on_odd_rows(odd, size, hot):
    s = repeats.RepeatSettings(block_bytes=size, hot=hot)
    got = removal(repeats.without_repeats(odd, s))
    first = sorted({(k, t) for k, t, _, _ in odd_rows()}, key=lambda r: (r[0] is not None, r[0] or 0))
    plain = plain_removal(first)
    assert sorted(set(got), key=str) == plain and len(got) == len(odd_rows())


def test_removal_of_pieces(spark):
    rng = np.random.default_rng(5)
    parts = [prose(i, 40) for i in range(12)]
    rows = [(i, "|".join(parts[j][rng.integers(0, 80) :] for j in rng.integers(0, 12, 4)) + "é" * 3) for i in range(60)]
    df = frame(spark, [(k, t, "en", "a") for k, t in rows], clash=False)
    for hot in (20_000, 3):
        s = repeats.RepeatSettings(block_bytes=3000, hot=hot)
        assert removal(repeats.without_repeats(df, s)) == plain_removal(rows)
    cut = repeats.cut_documents(df)
    assert cut.columns == df.columns
    kept = {r["doc_id"]: r["text"] for r in cut.collect()}
    for key, _, _, _, sha in plain_removal(rows):
        if "\ufffd" not in kept[key] and hashlib.sha256(kept[key].encode()).hexdigest() != sha:
            assert "é" in dict(rows)[key]  # a cut through a character takes all of it


def test_removal_of_nothing(empty):
    assert repeats.without_repeats(empty).count() == 0
    assert repeats.cut_documents(empty).count() == 0


def test_merged_transforms_find_classes():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(3):
        strings = [rng.integers(1, 3, rng.integers(8, 30)) for _ in range(20)]
        rows.append(np.concatenate([np.r_[s, 0] for s in strings]).astype(np.uint16))
    for depth in (6, 7):
        classes = bwt.merge(rows, depth)
        named = defaultdict(set)
        for row, found in zip(rows, classes):
            for i in range(len(row) - depth + 1):
                if row[i : i + depth].all():
                    named[row[i : i + depth].tobytes()].add(int(found[i]))
        assert all(len(v) == 1 for v in named.values())
        assert len({next(iter(v)) for v in named.values()}) == len(named)


def test_a_hot_anchor_spreads_over_the_buckets(spark, monkeypatch, tmp_path):
    """A passage in a third of the rows, each time with its own surroundings."""
    passage = prose(77, 60)
    rows = [
        (i, f"{prose(1000 + i, 30)} {passage} {prose(5000 + i, 30)}" if i % 3 == 0 else prose(9000 + i, 60)) for i in range(900)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, largest = repeats._compare_strings, []
    for hot in (20_000, 30):
        folder = tmp_path / str(hot)
        folder.mkdir()

        def watched(s, folder=str(folder)):
            inner = plain(s)

            def run(t):
                size = sum(len(v.as_buffer()) for c in ("text", "single") for v in t.column(c) if v.is_valid)
                open(f"{folder}/{t.column('bucket')[0].as_py()}", "w").write(str(size))
                return inner(t)

            return run

        monkeypatch.setattr(repeats, "_compare_strings", watched)
        got = removal(repeats.without_repeats(df, repeats.RepeatSettings(block_bytes=20_000, hot=hot)))
        assert got == plain_removal(rows)
        largest.append(max(int(f.read_text()) for f in folder.iterdir()))
    # One anchor alone has 300 strings of over 100 bytes.
    assert largest[0] > 30_000 and largest[1] < 0.6 * largest[0]
