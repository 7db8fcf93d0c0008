"""Pages that share an address, held against the SQL of the queries."""

from collections import Counter

import __spark_entry__ as entry
import duckdb
import pytest

PAGE = '<!DOCTYPE html><html lang="{}"><head><title>t</title></head><body><nav><ul>{}</ul></nav><div class="ad">ad</div><article>{}</article></body></html>'


def page(lang, links, n):
    return PAGE.format(lang, "".join(f'<li><a href="/{x}">{x}</a></li>' for x in links), "<p>one<br>two</p>" * n)


#: page_id, url and html: two addresses of two pages, one of three, one of one.
PAGES = [
    (0, "http://h.org/a", page("en", "uvw", 1)),
    (1, "http://h.org/b", page("en", "xy", 2)),
    (4, "http://h.org/a", page("fr", "zux", 3)),
    (5, "http://h.org/c", page("de", "xyzw", 1)),
    (6, "http://h.org/d", page("de", "q", 2)),
    (7, "http://h.org/b", page("es", "yw", 4)),
    (9, "http://h.org/d", page("de", "qq", 5)),
    (10, "http://h.org/d", page("fr", "r", 6)),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("repeated"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).sortWithinPartitions("page_id").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", ["fetched_pages", "labelled_pages", "downloaded_bodies", "element_children", "element_siblings", "element_attributes", "element_anchors", "leaf_counts", "position_groups", "action_links"])
def test_against_sql(spark, folder, name):
    db = duckdb.connect()
    db.execute("SET threads = 1")  # ties that the SQL leaves open go by the table's order
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    out = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in out.description]
    expected = Counter(out.fetchall())
    assert Counter(tuple(r) for r in entry.queries()[name](spark, folder).select(columns).collect()) == expected
