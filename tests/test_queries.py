import pytest

import html_tree as html
from oracle import same, views
from quire.plans import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


def _by_hand(con):
    """The queries over leaf blocks by another reading: a tree, page by page and without Spark."""
    blocks, links, kinds = [], {}, {}
    for page, source in con.sql("SELECT page_id, html FROM pages").fetchall():
        body = html.body_of(source)
        html.wrap_rows(body)
        html.split_breaks(body)
        for n, (_, xpath, tag, text, _, _, own, _) in enumerate(x for x in html.leaves(body) if len(x[3]) >= 2):
            blocks.append((page, n, xpath, tag, text))
            kinds.setdefault((page, tag), []).append(len(text))
            for href, _, _ in own:
                links.setdefault(href, []).append(page)
    return {"dom_leaf_blocks": blocks, "page_links": [(h, len(p), len(set(p))) for h, p in links.items()], "page_block_kinds": [(*k, len(n), sum(n)) for k, n in kinds.items()]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLE_SQL:
        same(df, con, ORACLE_SQL[name])
    else:
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(_by_hand(con)[name], key=repr)


def test_listings_are_in_order(spark, con):
    """The rows of a listing come in its order: shelf, row, slot, position, place by hand, age."""
    from quire.operators import shelf
    from quire.plans import relational as R

    rows = shelf.listing(R._books(spark, FOLDER), R._placements(spark, FOLDER), R._slots(spark, FOLDER), R._labels(spark, FOLDER), spark.createDataFrame([], "shelf_id string, book_id long, position long"), R.USER)
    got = [r.id for r in rows.collect()]
    want = con.sql(f"""
        WITH {R.SHELF_SQL} SELECT b.id FROM books b LEFT JOIN placements p ON p.book_id = b.id LEFT JOIN slots s ON s.id = p.slot_id WHERE b.user_id IS NULL OR b.user_id = 7
        ORDER BY s.id IS NULL, coalesce(s.shelf_id, CASE WHEN b.user_id IS NULL THEN '{shelf.PUBLIC_SHELF}' ELSE '{shelf.USER_SHELF}' END), coalesce(s.sort_order, {shelf.NO_ORDER}),
                 coalesce(p.position, b.display_order, 0), b.display_order NULLS FIRST, b.created_at NULLS FIRST, b.id""").fetchall()
    assert got == [x for (x,) in want]
