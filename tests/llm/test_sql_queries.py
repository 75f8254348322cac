"""Every training-data query with SQL gives the rows DuckDB gives, on tables and on odd rows."""

import duckdb
import pytest

import corpus_pipeline
from cases import empty, odd  # noqa: F401
from modlens.llm import exact_dedup, quality, url_rules
from modlens.llm.registry import QUERIES
from modlens.sources.tables import small_table


def ordered(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(r[i] for i in at)) for r in rows)


def from_duck(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return ordered(names, cursor.fetchall())


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name].run(spark, folder)
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == from_duck(con, QUERIES[name].sql)


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "near_duplicates", "repeated_passages", "packing"
    ]


def on_odd_rows(odd, sql):
    con = duckdb.connect()
    con.register("documents", odd.toArrow())
    return from_duck(con, sql)


def test_quality_on_odd_rows(odd):
    got = quality.judge(odd).select("doc_id", *quality.COUNTS, "base_failed", "kept")
    assert ordered(got.columns, [tuple(r) for r in got.collect()]) == on_odd_rows(odd, quality.SQL)


def test_quality_counts_repeats(spark):
    text = "a b c x a b c y a b c z q"
    row = spark.range(1).select(*[c.alias(n) for n, c in quality.text_counts(quality.F.lit(text)).items()]).first()
    assert (row["n_words"], row["n_repeat_words"]) == (13, 9)


def test_exact_dedup_classes(odd):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.classes(odd).collect()}
    # The null key sorts first among the four equal texts of one length.
    assert (5, None, 4, False) in got and (16, None, 4, False) in got and (None, None, 4, True) in got
    assert {(2, 2, 3, False), (4, 2, 3, False), (6, 6, 3, True)} & got == {(6, 6, 3, True)}
    assert (7, 7, 1, True) in got and (20, 20, 2, True) in got


def test_exact_dedup_survives_collisions(odd):
    # With identifiers of three bits nearly all chunks collide; the classes stay the same.
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(exact_dedup.classes(odd, bits=1)) == rows(exact_dedup.classes(odd))


def test_chunks_give_the_text_back(spark):
    long = ("Some words. " * 900).replace(" ", "")
    got = spark.range(1).select(exact_dedup.chunks(exact_dedup.F.lit(long)).alias("c")).first()["c"]
    assert "".join(got) == long and len(got) > 5 and max(map(len, got)) <= 4096


def test_url_rules_edge_cases(spark):
    urls = [
        None, "no scheme", "http://NET/x", "https://a.b.net/q?x#y", "http://xnet/", "http://example.net/en/a",
        "http://sub.Example.NET/EN/a", "ftp://example.com/de", "ftp://example.com/de/", "x://org/fr/",
        "x://org/fr", "http://free-bets.example.org/a", "http://free-betsy.example.org/", "http://a.net", "://", "http://a.net/",
    ]
    pages = small_table(spark, [(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = url_rules.judge(pages.drop("rule")).select("page_id", "host", "path", "rule", "verdict")
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    assert ordered(got.columns, [tuple(r) for r in got.collect()]) == from_duck(con, url_rules.SQL)


def test_url_rules_find_hosts_without_the_optional_letter(spark):
    hosts = ["free-bet.example.com", "a.free-bet", "x-free-bet.org", "free-bets.com", "free-betsy.com", "free.bet.com"]
    for chosen in (hosts, [h for h in hosts if "bets" not in h]):
        pages = spark.createDataFrame([(i, f"http://{h}/a") for i, h in enumerate(chosen)], "page_id long, url string")
        got = url_rules.judge(pages).select("page_id", "host", "path", "rule", "verdict")
        con = duckdb.connect()
        con.register("pages", pages.toArrow())
        rows = [tuple(r) for r in got.collect()]
        assert ordered(got.columns, rows) == from_duck(con, url_rules.SQL)
        assert [r[4] for r in sorted(rows)][:3] == ["block"] * 3


@pytest.mark.parametrize(
    "pattern", [r"(^|[.-])free-bets?([.-]|$)", r"(^|[.-])(free-)?bets*([.-]|$)", r"x-bets-|y", r"(^|[.-])a[-bets-]", r"-bets-?x"]
)
def test_url_rules_need_tokens_that_must_stand(pattern):
    with pytest.raises(ValueError):
        url_rules.rule_rows([], [(("bets",), pattern)])


def test_url_rules_need_a_token():
    with pytest.raises(ValueError):
        url_rules.rule_rows([], [((), "x+")])


def test_empty_tables(spark, empty):
    assert quality.judge(empty).count() == 0
    assert exact_dedup.classes(empty).count() == 0
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_stages_keep_columns(odd):
    good = quality.good_documents(odd)
    assert good.columns == odd.columns
    distinct = exact_dedup.distinct_documents(odd)
    assert distinct.columns == odd.columns
    ids = [r["doc_id"] for r in distinct.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted([None, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 20], key=str) or len(ids) == len(set(ids))
