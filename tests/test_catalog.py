"""Every registered query of the catalog against its SQL, on the smallest tables."""

import os

import pytest

from gleaner import catalog, catalog_made

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    held = duckdb.connect()
    for t in TABLES:
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return held


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    text = [tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)]
    return columns, sorted(text, key=str)


QUERIES, ORACLES = catalog.QUERIES | catalog_made.QUERIES, catalog.ORACLES | catalog_made.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLES[name]).df()
    # integers with nulls come as floats from one side or the other
    for c in got.columns:
        if str(got[c].dtype).startswith("float") != str(want[c].dtype).startswith("float"):
            got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
    assert len(want) > 0
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_store_discovery_ranks_whole_pages(spark, db):
    longest = dict(db.execute("SELECT arg_max(url, (length(html), -page_id)), arg_max(html, (length(html), -page_id)) FROM pages GROUP BY regexp_extract(url, '//([^/]*)', 1)").fetchall())
    got = [r.description for r in catalog.QUERIES["store_discovery"](spark, DATA).collect()]
    assert got and set(got) <= set(longest.values()) and max(map(len, got)) > 406


def test_embedding_refresh_reads_all_bridges(spark, db):
    import hashlib

    told = {}
    for item, *names in db.execute("SELECT DISTINCT l_partkey, s_name, n_name, r_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey").fetchall():
        for held, name in zip(told.setdefault(item, (set(), set(), set())), names):
            held.add(name)
    want = {}
    for item, name, kind in db.execute("SELECT p_partkey, p_name, p_type FROM part").fetchall():
        terms = [", ".join(sorted(t.strip() for t in held)) for held in told.get(item, ((), (), ()))]
        text = f"Name: {name}\nSpanish name: \nDescription: {kind}\nDescription_es: \nCategories: {terms[0]}\nMechanics: {terms[1]}\nFamilies: {terms[2]}"
        want[item] = ("old", 1, "", 0.0) if item % 3 == 0 else ("stub", 2, hashlib.sha256(text.encode()).hexdigest(), float(len(text)))
    got = catalog.QUERIES["embedding_refresh"](spark, DATA).collect()
    assert len(got) == len(want) and {r.item_id: (r.model, r.dims, r.source_hash, r.first) for r in got} == want


def test_page_titles_decode_what_their_sql_decodes(spark, tmp_path):
    import duckdb

    titles = ["a &amp;&amp; b&amp", "&lt;b&gt; &quot;c&#x27;", "caf&eacute; &amp;lt; &copy &#65; R&D", "&amp", "plain", ""]
    pages = [(i, f"<html><head><title>{t}</title></head><body>&amp <p>x</p></body></html>") for i, t in enumerate(titles)] + [(90, "<p>none</p>"), (91, ""), (92, None)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {r.page_id: r.title for r in catalog.QUERIES["page_titles"](spark, str(tmp_path)).collect()}
    assert got == dict(db.execute(catalog.ORACLES["page_titles"]).fetchall())
    assert got[0] == "a && b&amp" and got[92] is None
