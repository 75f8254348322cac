"""The pipeline against plain versions of its stages."""

import duckdb

import corpus_pipeline
from modlens.llm import quality
from modlens.session import checkpointed
from cases import empty, frame, odd, texts  # noqa: F401
from test_dedup import plain_components, plain_removal
from test_tokens import check_packing, pieces_of


def cut_text(text, seen, window=100):
    raw = (text or "").encode()
    gone = [False] * len(raw)
    for i in range(len(raw) - window + 1):
        if raw[i : i + window] in seen:
            gone[i : i + window] = [True] * window
        seen.add(raw[i : i + window])
    return bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")


def test_pipeline_rows(spark, folder, texts):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    good = {r[0] for r in con.execute(f"select doc_id from ({quality.SQL}) where kept").fetchall()}
    docs = [(k, t) for k, t in texts if k in good]
    best = {}
    for k, t in docs:
        norm = "".join((t or "").translate({c: " " for c in range(9, 14)}).split(" "))
        best[norm] = min(best.get(norm, (0, 1 << 60)), (-len(t or ""), k))
    stays = {k for _, k in best.values()}
    docs = [(k, t) for k, t in docs if k in stays]
    first = {k for k, _, c in plain_components(docs) if k == c}
    seen = set()
    docs = [(k, cut_text(t, seen)) for k, t in docs if k in first]
    rows = corpus_pipeline.run(spark, folder).collect()
    used, least = check_packing(rows, pieces_of(docs), 4096)
    assert used <= least * 1.02 + 1


def test_stages_on_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            alone = stage(spark, docs, "")
            assert alone.columns == docs.columns
            alone.count()
            now = checkpointed(stage(spark, now, ""))
        assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() >= 0


def test_cut_documents_keep_other_rows(spark):
    df = frame(spark, [(1, "short", "en", "a"), (2, None, "en", "a")])
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    assert got == {1: "short", 2: None}
    assert plain_removal([(1, "short")])[0][2] == 0
