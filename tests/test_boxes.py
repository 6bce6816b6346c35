import math
import random

import pytest
from pyspark.sql import functions as F

from pagetree.functions import geometry as g
from pagetree.operators import boxes

SCHEMA = "sample_id int, node_idx int, x1 double, y1 double, x2 double, y2 double"


def random_boxes(kind, seed=1):
    rnd = random.Random(seed)
    q = (lambda v: float(int(v))) if kind == "whole" else (lambda v: round(v * 4) / 4 + 0.125)
    rows = []
    for s in range(16):
        for i in range(rnd.randint(1, 30)):
            m = rnd.choice([8, 40, 224])
            x1, y1 = q(rnd.uniform(0, m)), q(rnd.uniform(0, m))
            x2 = x1 + q(rnd.uniform(0, m)) if rnd.random() < 0.7 else x1
            y2 = y1 + q(rnd.uniform(0, m))
            rows.append((s, i, min(x1, 224.0), min(y1, 224.0), min(x2, 224.0), min(y2, 224.0)))
    return rows


def smallest_container(rows, mode):
    found = set()
    for s, j, *b in rows:
        area = (b[2] - b[0]) * (b[3] - b[1])
        around = []
        for t, i, *o in rows:
            if t != s or i == j or not (o[0] <= b[0] and o[1] <= b[1] and o[2] >= b[2] and o[3] >= b[3]):
                continue
            outer = (o[2] - o[0]) * (o[3] - o[1])
            if mode == "reference" or outer > area or (outer == area and i < j):
                around.append((outer, i))
        found.add((s, j, min(around)[1] if around else -1))
    return found


@pytest.mark.parametrize("kind", ["whole", "fractions"])
@pytest.mark.parametrize("mode", ["strict", "reference"])
@pytest.mark.parametrize("limit", [1000, 5])
def test_containment(spark, kind, mode, limit):
    rows = random_boxes(kind)
    df = spark.createDataFrame(rows, SCHEMA)
    got = boxes.parent_by_containment(df, mode, page_limit=limit)
    assert {(r.sample_id, r.node_idx, r.box_parent) for r in got.collect()} == smallest_container(rows, mode)


@pytest.mark.parametrize(
    "page, want",
    [
        ([(0, 0, 100, 100), (10, 10, 50, 50)], [-1, 0]),
        ([(0, 0, 40, 40), (60, 60, 100, 100)], [-1, -1]),
        ([(0, 0, 100, 100), (10, 10, 80, 80), (20, 20, 60, 60)], [-1, 0, 1]),
        ([(0, 0, 10, 10), (0, 0, 10, 10)], [-1, 0]),
    ],
)
def test_containment_examples(spark, page, want):
    df = spark.createDataFrame([(0, i, *map(float, b)) for i, b in enumerate(page)], SCHEMA)
    got = boxes.parent_by_containment(df).orderBy("node_idx").collect()
    assert [r.box_parent for r in got] == want


def test_reference_mode_lets_identical_boxes_hold_each_other(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 9.0, 9.0), (0, 1, 0.0, 0.0, 9.0, 9.0)], SCHEMA)
    for limit in (10, 1):
        got = boxes.parent_by_containment(df, "reference", page_limit=limit).orderBy("node_idx")
        assert [r.box_parent for r in got.collect()] == [1, 0]


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.8])
def test_alignment_equals_all_pairs(spark, threshold):
    rows = random_boxes("fractions", 3)
    want = set()
    for s, i, x1, y1, x2, y2 in rows:
        for p in range(196):
            px, py = p % 14 * 16, p // 14 * 16
            w, h = min(x2, px + 16) - max(x1, px), min(y2, py + 16) - max(y1, py)
            inter = w * h if w > 0 and h > 0 else 0.0
            small = min((x2 - x1) * (y2 - y1), 256)
            score = inter / small if inter > 0 and small else 0.0
            if score >= threshold:
                want.add((s, i, p))
    df = spark.createDataFrame(rows, SCHEMA)
    got = boxes.align_nodes_patches(df, threshold)
    assert {(r.sample_id, r.node_idx, r.patch_idx) for r in got.collect()} == want
    if threshold > 0:
        listed = df.select("sample_id", "node_idx", F.explode(boxes.positive_patches(g.box(), threshold)).alias("p"))
        assert {tuple(r) for r in listed.collect()} == want


def test_iou(spark):
    row = spark.range(1).select(
        g.bbox_iou(*[tuple(map(F.lit, b)) for b in [(0.0, 0.0, 100.0, 100.0), (50.0, 50.0, 150.0, 150.0)]]),
        g.bbox_iou(*[tuple(map(F.lit, b)) for b in [(0.0, 0.0, 100.0, 100.0), (200.0, 200.0, 300.0, 300.0)]]),
        g.intersection_area(*[tuple(map(F.lit, b)) for b in [(0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 20.0, 10.0)]]),
    ).first()
    assert row[0] == pytest.approx(2500 / 17500) and row[1] == 0 and row[2] == 0


def test_scaled_boxes_stay_inside(spark):
    px = [(-50.0, -1.0, 3000.0, 900.0), (640.0, 400.0, 1280.0, 800.0)]
    df = spark.createDataFrame([(0, i, *b) for i, b in enumerate(px)], SCHEMA)
    got = df.select(*g.scale_box(g.box())).collect()
    assert tuple(got[0]) == (0.0, 0.0, 224.0, 224.0)
    assert tuple(got[1]) == pytest.approx((112.0, 112.0, 224.0, 224.0))


def test_select_structure(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.1)], "model_parent int, box_parent int, confidence double")
    for mode, want in (("model", [1, 1]), ("heuristic", [2, 2]), ("hybrid", [1, 2])):
        assert [r.parent_idx for r in boxes.select_structure(df, mode).collect()] == want


def test_containers_are_not_sorted_by_box(spark):
    """The least container is kept in a hash table, with texts and numbers beside it; ties and nulls as before."""
    boxes_ = [(0, 0, 9, 9), (0, 0, 9, 9), (1, 1, 4, 5), (1, 1, 5, 4), (2, 2, 3, 3), (None, 0, 1, 1), (2, 2, 1, 1)]
    rows = [(0, i, f"n{i}" if i else None, *[None if e is None else float(e) for e in b], [i]) for i, b in enumerate(boxes_)]
    df = spark.createDataFrame(rows, "sample_id int, node_idx int, t string, x1 double, y1 double, x2 double, y2 double, l array<int>")
    for mode, want in (("strict", [-1, 0, 0, 0, 2, -1, -1]), ("reference", [1, 0, 0, 0, 2, -1, -1])):
        found = boxes.parent_by_containment(df, mode).orderBy("node_idx").collect()
        assert [r.box_parent for r in found] == want and [tuple(r)[:-1] for r in found] == rows
        plan = boxes.parent_by_containment(df.drop("l"), mode)._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_order_of_area_and_index_as_one_number(spark):
    """Neighbouring floats keep their order; on large pages no container is sorted either."""
    rnd = random.Random(5)
    areas = [0.0, 1.0, 2.0**-900, 2.0**900]
    for _ in range(300):
        x = rnd.choice([rnd.uniform(0, 5e4), 2.0 ** rnd.randint(-900, 900), float(rnd.randint(0, 50000))])
        areas += [x, math.nextafter(x, math.inf), abs(math.nextafter(x, 0))]
    rows = [(a, rnd.randint(0, 2**31 - 1)) for a in areas]
    df = spark.createDataFrame(rows, "a double, i int").select("a", "i", boxes._smallest_first(F.col("a"), F.col("i")).alias("o"))
    assert [(r.a, r.i) for r in df.orderBy("o").collect()] == sorted(rows)
    nodes = spark.createDataFrame(random_boxes("whole"), SCHEMA)
    plan = boxes.parent_by_containment(nodes, page_limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
