"""Box operators on drawn pages, and the page algorithms: literal cases and invariants."""

import random

import pytest

from folioscope.operators import layout as L
from folioscope.operators import pages as P

SCHEMA = "doc_id long, pg int, ord int, text string, x0 double, y0 double, x1 double, y1 double"


def page(spark, *boxes):
    return spark.createDataFrame([(1, 0, i, "t", *map(float, b)) for i, b in enumerate(boxes)], SCHEMA)


def test_overlap_is_found_once_over_bands(spark):
    lay = page(spark, (0, 0, 100, 200), (10, 50, 90, 190), (200, 0, 300, 10))
    assert [(r.a_ord, r.b_ord) for r in L.overlaps(lay).collect()] == [(0, 1)]


def test_rooms(spark):
    lay = page(spark, (0, 0, 100, 10), (0, 30, 100, 40), (150, 0, 200, 10))
    assert {r.ord: r.room for r in L.free_below(lay, 50.0).collect()} == {0: 20.0, 1: 50.0, 2: 50.0}
    assert {r.ord: r.room for r in L.free_right(lay, 99.0).collect()} == {0: 50.0, 1: 99.0, 2: 99.0}


def test_union_area(spark):
    assert L.union_area(page(spark, (0, 0, 10, 10), (5, 5, 15, 15), (20, 0, 21, 1))).first().covered == 176.0


def test_xy_cut_reads_columns_in_turn(spark):
    lay = page(spark, (0, 0, 100, 10), (200, 0, 300, 10), (0, 12, 100, 22), (200, 12, 300, 22), (0, 24, 100, 34), (200, 24, 300, 34))
    assert [r.ord for r in P.xy_cut(lay).orderBy("place").collect()] == [0, 2, 4, 1, 3, 5]


def test_grid_and_closure(spark):
    lay = page(spark, (0, 0, 10, 10), (50, 1, 60, 11), (0, 20, 10, 30))
    assert {(r.ord, r.row, r.col) for r in P.table_grid(lay).collect()} == {(0, 0, 0), (1, 0, 1), (2, 1, 0)}
    chain = page(spark, (0, 0, 10, 10), (0, 5, 10, 15), (0, 10, 10, 20), (50, 0, 60, 10))
    assert sorted(r.ord for r in P.closure(L.overlaps(chain), chain.where("ord = 0")).collect()) == [0, 1, 2]
    assert sorted(r.ord for r in P.closure(L.overlaps(chain), chain.where("ord = 3")).collect()) == [3]


def test_nms_drops_what_holds_two_and_what_a_better_one_covers(spark):
    rows = [(1, 0, i, "t", *map(float, b)) for i, b in enumerate([(0, 0, 100, 100), (0, 0, 40, 40), (50, 50, 90, 90), (1, 1, 41, 41)])]
    boxes = spark.createDataFrame([(*r, s) for r, s in zip(rows, (9.0, 2.0, 1.0, 1.0))], SCHEMA + ", score double")
    assert sorted(r.ord for r in P.greedy_nms(boxes).collect()) == [1, 2]


def test_paragraphs_go_on_past_a_margin_note(spark):
    lay = page(spark, (110, 0, 500, 10), (100, 12, 500, 22), (10, 12, 40, 22), (100, 24, 500, 34), (115, 36, 500, 46))
    got = {r.ord: r.paragraph for r in P.paragraphs(lay).collect()}
    assert got[0] == got[1] == got[3] and got[2] not in (got[0], got[4]) and got[4] != got[0]


def test_side_by_side_cells(spark):
    lay = page(spark, (0, 0, 40, 10), (60, 0, 100, 10), (0, 12, 40, 22), (55, 24, 70, 34)).selectExpr("*", "0 as block").drop("text").selectExpr("*", "element_at(array('Plate', 'see http-', 'path', 'More'), ord + 1) as text")
    got = {r.ord: r.cell for r in P.side_by_side(lay).collect()}
    assert got[0] != got[1] == got[2] == got[3]


def test_rows_split_at_an_empty_gap_only(spark):
    apart = page(spark, (0, 0, 80, 10), (100, 0, 200, 10), (0, 12, 80, 22), (100, 12, 200, 22))
    assert len({r.part for r in P.side_rows(apart).collect()}) == 2
    crossed = page(spark, (0, 0, 80, 10), (100, 0, 200, 10), (0, 12, 200, 22))
    assert len({r.part for r in P.side_rows(crossed).collect()}) == 1


def test_table_cells_stop_at_rules_and_gaps(spark):
    lay = page(spark, (0, 0, 40, 10), (0, 12, 40, 22), (0, 26, 40, 36), (0, 60, 40, 70), (100, 0, 140, 10))
    rules = spark.createDataFrame([(1, 0, 0.0, 24.0, 50.0)], "doc_id long, pg int, x0 double, y0 double, x1 double")
    got = {r.ord: r.cell for r in P.table_cells(lay, rules).collect()}
    assert got[0] == got[1] and len({got[0], got[2], got[3], got[4]}) == 4


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(3)
    rows = [(d, p, i, "x" * rng.randint(1, 9), x := float(rng.randrange(0, 500, 20)), y := float(rng.randrange(0, 700, 6)), x + rng.randrange(10, 200), y + rng.choice([10, 12, 30])) for d in range(9) for p in range(3) for i in range(rng.choice([1, 2, 30]))]
    return spark.createDataFrame(rows, SCHEMA), {(r[0], r[1], r[2]) for r in rows}


@pytest.mark.parametrize("run,column", [(P.xy_cut, "place"), (P.reading_order, "place"), (P.table_grid, None), (P.boxes_to_lines, None), (P.wrapped_lines, None), (P.paragraphs, None), (P.side_rows, None)])
def test_every_box_once_and_orders_are_permutations(drawn, run, column):
    lay, keys = drawn
    got = run(lay).collect()
    assert len(got) == len(keys) and {(r.doc_id, r.pg, r.ord) for r in got} == keys
    if column:
        by = {}
        for r in got:
            by.setdefault((r.doc_id, r.pg), []).append(r[column])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_wrapped_chains_run_downwards(drawn):
    lay, _ = drawn
    box = {(r.doc_id, r.pg, r.ord): r for r in lay.collect()}
    for r in P.wrapped_lines(lay).where("head <> ord").collect():
        assert box[(r.doc_id, r.pg, r.head)].y0 < box[(r.doc_id, r.pg, r.ord)].y0


def test_kept_boxes_do_not_cover_each_other(drawn):
    lay, _ = drawn
    kept = P.greedy_nms(lay.selectExpr("*", "cast(length(text) as double) as score"), 0.5).join(lay, ["doc_id", "pg", "ord"])
    assert L.overlaps(kept, 0.5).count() == 0


def test_paragraph_islands_count_from_the_top(drawn):
    lay, keys = drawn
    got = L.paragraphs(lay).collect()
    assert {(r.doc_id, r.pg, r.ord) for r in got} == keys and min(r.paragraph for r in got) in (0, 1)
