"""Registered queries: names, columns that match their SQL, and plans without products of tables."""

import contextlib
import io

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["post_outcomes", "clean_urls", "url_gate", "title_gate", "claimed_offers", "funnel", "source_health", "captured_posts", "validated_offers", "diverse_pick", "forum_posts", "articles", "free_models", "page_extracts", "manual_posts", "feed_items", "profile_posts", "written_offers", "fingerprints", "batch_replies", "resolved_urls", "health_stream", "normalized_titles", "greedy_dedup", "semantic_pairs", "unseen_pages", "mentioned_repos", "normalized_items", "time_labels", "retry_stream", "lease_stream", "upsert_stream", "pulled_messages", "sent_messages", "sketched_latency", "page_links", "title_search", "rendered_messages"])
def test_rows_match_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["post_outcomes", "dispatch_queue", "dispatch_preview", "fetch_fair", "title_gate", "yield_per_source", "send_latency", "attempt_fold"])
def test_plans_make_no_products(spark, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        __spark_entry__.queries()[name](spark, SF).explain("formatted")
    assert "CartesianProduct" not in text.getvalue() and "BroadcastNestedLoopJoin" not in text.getvalue()


def test_scans_read_only_what_is_used(spark):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        __spark_entry__.queries()["url_flags"](spark, SF).explain("formatted")
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text.getvalue()


def held_against_sql(spark, folder, name, **tables):
    """The query and its SQL over some tables made here."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in set(TABLES) - set(tables):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    want = con.sql(__spark_entry__.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    return sorted(map(tuple, df.collect())), sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_pages_of_one_url_have_their_own_redirects(spark, tmp_path):
    rows = [(i, f"https://a.example/{i % 5}/?b=1", "") for i in range(24)]
    got, want = held_against_sql(spark, tmp_path, "resolved_urls", pages=("page_id long, url string, html string", rows))
    assert got == want and len(got) == 24


def test_titles_of_letters_with_odd_capitals(spark, tmp_path):
    texts = [f"{c}eit und mehr" for c in "ßŉǰΐﬁᾳᾀƛıǆςéя"] + ["ß" * 150 + "x" * 100, "ΟΔΟΣ ΚΑΙ ΛΟΓΟΣ", "İSTANBUL VE İZMİR", "\x1c\x1fabc def\x1d", "• 1. ß", "", None, "\nx"]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    got, want = held_against_sql(spark, tmp_path, "normalized_titles", documents=("doc_id long, text string, lang string, source string, n_chars int", rows))
    assert got == want and got[0] == (0, "ẞeit und mehr")
