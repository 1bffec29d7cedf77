"""Named characters without a semicolon, as in a cut title: queries on pages and their SQL read them alike."""

import duckdb
import pytest

from lodestone import plans

HTML = "<html><body><p>One &amp two&amp;amp; &copy 3 &lt;b&gt</p><h1>Terms&amp;&amp</h1><p>and a text of some words &quot;here&quot</p><ul><li>&middot x</li></ul></body></html>"


@pytest.mark.parametrize("name", ["page_blocks", "page_html", "page_markdown", "page_titles", "passage_roles"])
def test_names_without_semicolon(spark, tmp_path, name):
    spark.createDataFrame([(1, "u", HTML), (2, "u", HTML.replace("&amp</h1>", "&am</h1>"))], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = plans.QUERIES[name](spark, str(tmp_path))
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    r = c.execute(plans.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(map(repr, (tuple(dict(zip(names, row, strict=True))[k] for k in sorted(names)) for row in r.fetchall()))) == got
    if name == "page_markdown":
        assert r"# Terms&&\n" in got[0]
