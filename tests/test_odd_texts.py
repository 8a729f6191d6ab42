"""Queries against their SQL on texts whose sentences begin and end with digits and blanks."""

import duckdb
import pytest

from stratalith.plans import catalog

TEXTS = [
    "0997 leads the first sentence of it. 1 is what the second one begins with. The third one has nothing at all. 3 and so on to the end of it. Fifth one ends with a 4",
    "0997 leads the first sentence of it. Some other sentence of claim length here. ",
    "997 leads the first sentence of it.  1 is what the second one begins with! 5 opens the sixth one of the text.",
    " A blank before this sentence of it. A tab\tin this one, and a line feed.\nSixth sentence or so it is 2. Is it 3? 4! A sentence beyond the first five 6. 6 is no claim of this text.",
    "A vertical tab is no blank here.\x0bIt goes on for a while then. Next one of claim length.\f\r\nAnother one of claim length.",
    "One. Two. Three. Four. Five. Six. 7 is said twice in this text here. 7 is said twice in this text here.",
    "", "   ", "12", None,
]


def differences(spark, folder, name: str, tables: dict[str, str]) -> list:
    """Rows that the query or its SQL has alone, over ``tables`` given as SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE texts (i BIGINT, t VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?)", list(enumerate(TEXTS)))
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = catalog.queries()[name](spark, str(folder))
    theirs = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    show = lambda rows: sorted(map(str, rows))
    ours = show(tuple(r) for r in found.collect())
    return [(x, y) for x, y in zip(ours, show(theirs), strict=True) if x != y]


DOCUMENTS = {"documents": "SELECT i AS doc_id, t AS text FROM texts"}


@pytest.mark.parametrize("name", ["claim_extract", "claim_traceability", "compile_packs", "new_sentences"])
def test_queries_of_sentences(spark, tmp_path, name):
    assert differences(spark, tmp_path, name, DOCUMENTS) == []


def test_compile_bricks(spark, tmp_path):
    pages = "SELECT i AS page_id, 'u' || i AS url, '<h1>Head ' || i || '</h1><p>' || t || '</p>' AS html FROM texts"
    assert differences(spark, tmp_path, "compile_bricks", {"pages": pages}) == []


def test_compile_bricks_of_odd_pages(spark, tmp_path):
    """Markup within dropped markup, and blanks and letters that only one kind of pattern takes for such."""
    rows = [
        "'<!-- <script> --> not shown </script> a page that begins after it. -->'",
        "'<style> <!-- </style> A claim after a broken comment. --> and one more claim of this page.'",
        "'<h1>' || chr(10) || 'The line after an empty heading.</h1>'", "'##' || chr(11) || 'No heading after a vertical tab.'",
        "'- ' || chr(11) || 'an item with a vertical tab' || chr(10) || '-' || chr(11) || 'no item at all, it says'",
        "'1. an item' || chr(13) || ' with a carriage return' || chr(13) || chr(10) || '2) another item here'",
        "'The word is a thing' || chr(13) || 'of two lines. A term' || chr(11) || 'here is a longer thing.'",
        "'Mi' || chr(383) || 's K i' || chr(383) || ' a long s in the verb. The ' || chr(8490) || ' is a sign of degrees.'",
        "'Term' || chr(11) || 'one: what is said of it. ' || chr(10) || 'Term two:' || chr(12) || 'what is said of it'", "''", "NULL",
    ]
    pages = f"SELECT i AS page_id, 'u' || i AS url, html FROM (VALUES {', '.join(f'({i}, {r})' for i, r in enumerate(rows))}) t(i, html)"
    assert differences(spark, tmp_path, "compile_bricks", {"pages": pages}) == []


@pytest.mark.parametrize("name", ["claim_traceability", "compile_packs", "new_sentences"])
def test_mark_of_sentences(spark, tmp_path, name):
    mark = "SELECT i AS doc_id, 'A sentence that ends at' || chr(1) || 'the mark that is in it. ' || chr(1) || ' And one more of document ' || i AS text FROM range(3) t(i)"
    long = "SELECT 3, string_agg('Sentence of the text ' || i || '.', chr(1) ORDER BY i) FROM range(9) t(i)"
    assert differences(spark, tmp_path, name, {"documents": f"{mark} UNION ALL {long}"}) == []


@pytest.mark.parametrize("name", ["compile_packs", "new_sentences"])
def test_documents_without_id(spark, tmp_path, name):
    documents = "SELECT CASE WHEN i % 3 > 0 THEN i % 5 END AS doc_id, t AS text FROM texts UNION ALL SELECT NULL, t FROM texts WHERE i < 6"
    assert differences(spark, tmp_path, name, {"documents": documents}) == []
