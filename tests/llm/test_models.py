"""Language and toxicity: parts against plain versions, held-out accuracy, odd rows."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from modlens.llm import language, toxicity
from modlens.llm.registry import QUERIES
from cases import empty, frame, odd, odd_rows, prose  # noqa: F401


def out_of_learning(key):
    return zlib.crc32(str(key).encode()) % 4 == 2


def plain_phrases(text, sample):
    """Greedy longest matches of stretches of text in a sample; unmatched symbols are phrases."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_are_longest_matches():
    samples = {"xx": [prose(1, 60)], "yy": [prose(2, 60)]}
    p = language.learn(samples, language.LanguageSettings())
    texts = [prose(3, 30), prose(1, 20), "", "abc!!1 2 def", prose(4, 300)]
    points, owner = language.code_points(texts)
    row, owner = language.symbols(points, owner, p.symbol_of)
    got = p.phrases(row, owner, len(texts))
    for s, name in enumerate(p.names):
        sample = language.symbols(*language.code_points(samples[name]), p.symbol_of)[0].tobytes()
        for n in range(len(texts)):
            own = row[owner == n]
            parts = [own[i : i + language.STRETCH].tobytes() for i in range(0, len(own), language.STRETCH)]
            assert got[n, s] == sum(plain_phrases(t, sample) for t in parts)


def in_script(first, letters, seed, words):
    """Words of two or three letters of a script, from a vocabulary of 600."""
    rng, known = np.random.default_rng(first), np.random.default_rng(seed)
    vocabulary = ["".join(chr(first + c) for c in rng.integers(0, letters, rng.integers(2, 4))) for _ in range(600)]
    return " ".join(vocabulary[w] for w in known.integers(0, 600, words))


SCRIPTS = {"am": (0x1200, 70), "ar": (0x628, 18), "el": (0x3B1, 17), "ka": (0x10D0, 33), "ko": (0xAC00, 900), "zh": (0x4E00, 900)}


def test_languages_of_other_scripts_beside_latin():
    samples = {n: [in_script(*of, k, 60) for k in range(75)] for n, of in SCRIPTS.items()}
    samples |= {"en": [prose(k, 60) for k in range(75)] * 3}
    p = language.learn(samples, language.LanguageSettings())
    texts = [(n, in_script(*of, 1000 + k, 20)) for n, of in SCRIPTS.items() for k in range(20)]
    texts += [("en", prose(1000 + k, 20)) for k in range(20)]
    got, score = language.judge(p, [t for _, t in texts])
    assert got == [n for n, _ in texts] and score.min() > 0.9
    # Phrases against a plain search, also with letters that no sample holds.
    mixed = [" ".join([texts[5][1], texts[105][1], "Ж" * 3, texts[-1][1]]), in_script(0x4E00, 1800, 3, 200)]
    points, owner = language.code_points(mixed)
    row, owner = language.symbols(points, owner, p.symbol_of)
    found = p.phrases(row, owner, len(mixed))
    for s, name in enumerate(p.names):
        symbols = language.symbols(*language.code_points([" ".join(samples[name])]), p.symbol_of)[0][:30_000]
        sample = "".join(map(chr, symbols.tolist()))
        for n in range(len(mixed)):
            own = "".join(map(chr, row[owner == n].tolist()))
            parts = [own[i : i + language.STRETCH] for i in range(0, len(own), language.STRETCH)]
            assert found[n, s] == sum(plain_phrases(t, sample) for t in parts)


def test_too_many_languages_stop_the_job(spark):
    docs = frame(spark, [(i, prose(i, 20), f"l{i % 5}", "a") for i in range(40)])
    assert len(language.sample(docs, language.LanguageSettings(languages=5))) == 5
    with pytest.raises(ValueError, match="5 languages"):
        language.sample(docs, language.LanguageSettings(languages=4))


def test_language_on_the_table(spark, folder):
    lang = dict(duckdb.sql(f"select doc_id, lang from '{folder}/documents.parquet'").fetchall())
    rows = QUERIES["op8_language"].run(spark, folder).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == out_of_learning(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark, odd, empty):
    s = language.LanguageSettings()
    parser = language.learn(language.sample(odd, s), s)
    got = {r["doc_id"]: r for r in language.identify(odd, parser).collect()}
    assert got[2]["lang_pred"] == got[4]["lang_pred"] == got[6]["lang_pred"] == "und" and got[2]["score"] == 0
    assert got[15]["lang_pred"] in ("de", "en") and len(got) == len({r[0] for r in odd_rows()})
    assert language.identify(empty, parser).count() == 0
    nothing = language.learn(language.sample(empty, s), s)
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}


def plain_nearest(q, vectors, keys, labels, near):
    """Cosine with every example, one after the other."""
    found = [(-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 9), int(k), y) for k, y, v in zip(keys, labels, vectors)]
    return [(-s, k, y) for s, k, y in sorted(f for f in found if f[0] < 0)[:near]]


def test_nearest_is_exact():
    rng = np.random.default_rng(4)
    terms = [f"t{i}" for i in range(40)]
    idf = {t: float(rng.uniform(1, 4)) for t in terms}
    draw = lambda n: toxicity.unit_vector(Counter(rng.choice(terms, n).tolist()), idf)
    vectors = [draw(rng.integers(1, 6)) for _ in range(700)] + [{}] * 3
    keys, labels = rng.permutation(703), rng.integers(0, 2, 703).astype(float)
    index = toxicity.Index(idf, keys, labels, vectors)
    asked = [draw(30 if n % 3 == 0 else 4) for n in range(600)] + [{"unknown": 1.0}, {}]
    got = index.nearest(asked, 15)
    for q, found in list(zip(asked, got))[::9] + [(asked[-1], got[-1]), (asked[-2], got[-2])]:
        plain = plain_nearest(q, vectors, keys, labels, 15)
        assert [(k, y) for _, k, y in found] == [(k, y) for _, k, y in plain]
        assert np.allclose([c for c, _, _ in found], [c for c, _, _ in plain])
    assert index.nearest([], 15) == []
    # Bounds leave blocks out for most texts.
    assert index.pruned > 0.5 * index.texts


def test_equal_examples_count_each():
    vectors = [{"a": 1.0}] * 40 + [{"b": 1.0}] * 3
    index = toxicity.Index({"a": 1.0, "b": 2.0}, range(100, 143), [1.0] * 43, vectors)
    got = index.nearest([{"a": 0.6, "b": 0.8}], 15)[0]
    assert [k for _, k, _ in got] == [140, 141, 142, *range(100, 112)]


def test_scores_rise_with_votes():
    x = np.array([0.0, 0.2, 0.2, 0.5, 0.6, 0.9, 1.0])
    y = np.array([0, 1, 0, 0, 1, 1, 1])
    edges, levels = toxicity.monotone(x, y, np.ones(7))
    assert (np.diff(levels) > 0).all() and (np.diff(edges) > 0).all() and levels[-1] == 1.0


def planted(n=240):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = prose(i, 40) + (" vile" * (i % 3 + 1) + " Rotten" if toxic else " fine day")
        rows.append((i, text, "en", "a"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_of_planted_words(spark):
    rows, labels = planted()
    docs = frame(spark, rows + rows[:12])
    known = spark.createDataFrame(labels + labels[:30] + [(None, 1, 1), (7777, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known, toxicity.ToxicitySettings(evidence=10.0))
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    for key, _, toxic in labels:
        assert (got[key]["score"] >= 0.3) == bool(toxic)
    evidence = got[0]["evidence"]
    assert evidence and not any(out_of_learning(k) for k in evidence)


def test_toxicity_of_odd_rows(spark, odd, empty):
    s = toxicity.ToxicitySettings()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = toxicity.train(odd, none, s)
    assert {r["score"] for r in toxicity.scored(odd, flat).collect()} == {0.0}
    one_kind = spark.createDataFrame([(5, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(odd, toxicity.train(odd, one_kind, s)).collect()
    assert len(rows) == len(odd_rows()) and {r["score"] for r in rows} == {1.0}
    assert toxicity.scored(empty, flat).count() == 0


def test_toxicity_on_the_table(spark, folder):
    """Every row's score and evidence against plain cosines with all examples."""
    rows = {r["doc_id"]: r for r in QUERIES["op5_toxicity"].run(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(rows) == sorted(texts)
    s = toxicity.ToxicitySettings()
    kept = {}
    plain, toxicity.Index = toxicity.Index, lambda *a: kept.setdefault("index", (a, plain(*a)))[1]
    try:
        model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), s)
    finally:
        toxicity.Index = plain
    for key, r in rows.items():
        assert r["held_out"] == out_of_learning(key) and r["predicted"] == int(r["score"] >= 0.3)
        if "index" not in kept or not kept["index"][0]:
            assert r["score"] == model.without
            continue
        idf, keys, labels, vectors = kept["index"][0]
        q = toxicity.unit_vector(Counter(t for t in toxicity.terms_of(texts[key]) if t in idf), idf)
        found = plain_nearest(q, vectors, keys, labels, s.near)
        assert r["evidence"] == [k for _, k, _ in found]
        if not found:
            assert r["score"] == model.without
            continue
        vote = sum(c * c * y for c, _, y in found) / sum(c * c for c, _, _ in found)
        at = max(int(np.searchsorted(model.edges, vote + 1e-12, side="right")) - 1, 0)
        assert np.isclose(r["score"], model.shares[at]) or np.isclose(vote, model.edges, atol=1e-9).any()


def test_toxicity_of_documents_held_out(spark):
    folder = "/root/testdata/sf0.1"
    truth = dict(duckdb.sql(f"select doc_id, max(toxic) from '{folder}/labels.parquet' group by 1").fetchall())
    got = QUERIES["op5_toxicity"].run(spark, folder).filter("held_out").collect()
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth]
    toxic = [p for p, y in held if y]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(p != y for p, y in held) <= 0.04 * len(held)
