"""Decoding, metrics and losses against plain Python on small random pages."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagetree.operators import decode, losses, metrics
from pagetree.plans import tables as t

SCORES = "sample_id int, node_idx int, cand_idx int, score double"


@pytest.fixture(scope="module")
def page_set():
    rnd = random.Random(5)
    pages = {}
    for s in range(25):
        n = rnd.randint(1, 9)
        types = [rnd.randint(0, 8) for _ in range(n)]
        # few distinct scores, so that ties arise; the root column is at index n
        logits = [[rnd.randint(0, 12) / 4 for _ in range(n + 1)] for _ in range(n)]
        pages[s] = (types, logits)
    return pages


@pytest.fixture(scope="module")
def tables(spark, page_set):
    scores, types = [], []
    for s, (kinds, logits) in page_set.items():
        n = len(kinds)
        for i, row in enumerate(logits):
            types.append((s, i, kinds[i]))
            scores += [(s, i, j if j < n else -1, v) for j, v in enumerate(row)]
    return (
        spark.createDataFrame(scores, SCORES).cache(),
        spark.createDataFrame(types, "sample_id int, node_idx int, type_idx int").cache(),
    )


def masked(types, logits):
    n = len(types)
    leaf = [3 <= k <= 6 for k in types]
    return [[v if j == n or (j != i and not leaf[j]) else -1e4 for j, v in enumerate(row)] for i, row in enumerate(logits)]


def layer_by_layer(types, logits, max_depth=16):
    """All candidates ranked, nodes placed layer after layer; ties to the lower index, root last."""
    n = len(types)
    rows = masked(types, logits)
    ranked = [sorted(range(n + 1), key=lambda j: (-row[j], j)) for row in rows]
    parent = {i: -1 for i in range(n) if ranked[i][0] == n}
    depth = {i: 0 for i in parent}
    for d in range(1, max_depth):
        hosts = {i for i in depth if depth[i] == d - 1 and not 3 <= types[i] <= 6}
        found = {}
        for i in range(n):
            if i not in parent:
                hit = [j for j in ranked[i] if j in hosts]
                if hit:
                    found[i] = hit[0]
        if not found:
            break
        parent.update(found)
        depth.update({i: d for i in found})
    return [parent.get(i, -1) for i in range(n)]


def by_node(df, column):
    return {(r.sample_id, r.node_idx): r[column] for r in df.collect()}


def test_decode_parents(tables, page_set):
    got = by_node(decode.decode_parents(*tables), "model_parent")
    want = {(s, i): p for s, page in page_set.items() for i, p in enumerate(layer_by_layer(*page))}
    assert got == want
    assert set(want.values()) > {-1}


@pytest.mark.parametrize("limit", [512, 0])
def test_layered_decoding_agrees_on_full_tables_and_goes_deeper_on_sparse_ones(spark, tables, limit):
    full = by_node(decode.decode_parents_layered(*tables, page_limit=limit), "model_parent")
    assert full == by_node(decode.decode_parents(*tables), "model_parent")
    chain = [(0, i, i - 1, 5.0) for i in range(1, 6)] + [(0, i, -1, 0.0 if i else 9.0) for i in range(6)]
    types = spark.createDataFrame([(0, i, 0) for i in range(6)], "sample_id int, node_idx int, type_idx int")
    scores = spark.createDataFrame(chain, SCORES)
    deep = by_node(decode.decode_parents_layered(scores, types, page_limit=limit), "model_parent")
    assert [deep[0, i] for i in range(6)] == [-1, 0, 1, 2, 3, 4]
    cut = by_node(decode.decode_parents_layered(scores, types, max_depth=3, page_limit=limit), "model_parent")
    assert [cut[0, i] for i in range(6)] == [-1, 0, 1, -1, -1, -1]


def test_confidence_and_hybrid(spark, tables, page_set):
    scores, types = tables
    probs, model = {}, {}
    for s, page in page_set.items():
        decoded = layer_by_layer(*page)
        for i, row in enumerate(masked(*page)):
            top = max(row)
            probs[s, i] = 1 / sum(math.exp(v - top) for v in row)
            model[s, i] = decoded[i]
    sure = by_node(decode.softmax_confidence(decode.mask_scores(decode.candidate_parents(scores, types))), "confidence")
    assert sure == pytest.approx(probs)
    boxed = types.select("sample_id", "node_idx", F.lit(7).alias("box_parent"))
    got = by_node(decode.hybrid_parents(scores, types, boxed), "parent_idx")
    assert got == {k: model[k] if probs[k] >= 0.3 else 7 for k in probs}


def test_confidence_survives_large_scores(spark):
    df = spark.createDataFrame([(0, 0, -1, 5000.0), (0, 0, 1, 4999.0)], SCORES)
    assert decode.softmax_confidence(df).first().confidence == pytest.approx(1 / (1 + math.exp(-1)))


def test_parent_cross_entropy(spark, tables, page_set):
    rnd = random.Random(9)
    gold, want = [], []
    for s, (types, logits) in page_set.items():
        n = len(types)
        for i, row in enumerate(logits):
            target = rnd.randint(-1, n + 1)  # beyond the page counts as root
            gold.append((s, i, target))
            hit = row[target] if 0 <= target < n else row[n]
            want.append(math.log(sum(math.exp(v) for v in row)) - hit)
    nodes = spark.createDataFrame(gold, "sample_id int, node_idx int, gold_parent int")
    got = losses.parent_cross_entropy(tables[0], nodes).first().struct
    assert got == pytest.approx(sum(want) / len(want))


def test_prf_agree_and_empty_pages_score_one(spark):
    nodes = spark.createDataFrame([(1, 0, -1, -1), (1, 1, 0, -1)], "sample_id int, node_idx int, gold_parent int, pred_parent int")
    pages = spark.createDataFrame([(1,), (2,)], "sample_id int")
    got = {r.sample_id: (r.precision, r.recall, r.f1) for r in metrics.parent_prf(nodes, pages=pages).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (1.0, 1.0, 1.0)}


def test_macro_and_micro_differ(spark):
    rows = [(1, 0, 1, 1), (2, 0, 1, 0), (2, 1, 1, 0), (2, 2, 1, 1)]
    nodes = spark.createDataFrame(rows, "sample_id int, node_idx int, gold_type int, pred_type int")
    assert metrics.macro_average(metrics.type_accuracy(nodes)).first().type_acc == pytest.approx(2 / 3)
    assert metrics.micro_average(nodes, "gold_type", "pred_type", "a").first().a == 0.5
    wide = {r.gold_type: r for r in metrics.confusion_wide(nodes).collect()}
    assert len(wide) == 9 and wide[1].p0 == 2 and wide[1].p1 == 2 and wide[3].p3 == 0


@pytest.fixture(scope="module")
def cells(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(12):
        sim = [rnd.uniform(-60, 60) for _ in range(9)]
        pos = sorted(rnd.sample(range(9), rnd.randint(0, 4)))
        rows.append((i // 5, i, sim, pos))
    return rows, spark.createDataFrame(rows, "sample_id int, node_idx int, sim array<double>, positives array<int>").cache()


@pytest.mark.parametrize("padded", [False, True])
def test_weighted_bce(cells, padded):
    rows, df = cells
    n_pos = sum(len(p) for *_, p in rows)
    n_cells = 3 * 20 * 9 if padded else 12 * 9
    weight = min(max(n_cells - n_pos, 1) / max(n_pos, 1), 20)
    total = 0.0
    for *_, sim, pos in rows:
        for j, x in enumerate(sim):
            total += weight * _softplus(-x) if j in pos else _softplus(x)
    got = losses.weighted_bce(losses.cells_of(df), n_cells if padded else None)
    assert got.first().align_bce == pytest.approx(total / (12 * 9))


def _softplus(x):
    return max(x, 0) + math.log1p(math.exp(-abs(x)))


def test_infonce(spark, cells):
    rows, df = cells
    want = []
    for *_, sim, pos in rows:
        if pos:
            s = [x / 0.1 for x in sim]
            want.append(max(s) + math.log(sum(math.exp(x - max(s)) for x in s)) - s[pos[0]])
    assert losses.infonce(df).first().align_nce == pytest.approx(sum(want) / len(want))
    none = spark.createDataFrame([(0, 0, [1.0], [])], "sample_id int, node_idx int, sim array<double>, positives array<int>")
    assert losses.infonce(none).first().align_nce == 0.0
    dense = spark.createDataFrame([([0, 1, 1, 0],)], "labels array<int>")
    assert dense.select(losses.positives_of(F.col("labels")).alias("p")).first().p == [1, 2]


def test_weighted_total(spark):
    row = spark.range(1).select(
        F.create_map(F.lit("type"), F.lit(2.0), F.lit("struct"), F.lit(4.0), F.lit("new"), F.lit(3.0)).alias("m")
    )
    assert row.select(losses.weighted_total(F.col("m")).alias("t")).first().t == pytest.approx(2 + 2 + 3)
    assert row.select(losses.weighted_total(F.col("m"), {"new": 0.0}).alias("t")).first().t == pytest.approx(4)


def test_argmax_takes_the_lowest_on_ties(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 3.0, 3.0])], "sample_id int, node_idx int, type_scores array<double>")
    assert decode.argmax_type(df).first().type_idx == 1


@pytest.mark.parametrize("limit", [1000, 3])
def test_structure_metrics(spark, limit):
    """Each mode as full_metrics has it, gathered in a row or walked as joins."""
    rnd = random.Random(2)
    rows = [(s, i, *[rnd.randint(-1, i - 1) for _ in range(3)], 0, 0) for s in range(8) for i in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(rows, "sample_id int, node_idx int, gold_parent int, a int, b int, gold_type int, pred_type int")
    columns = ("sample_id", "parent_p", "parent_r", "parent_f1", "tree_edit")
    got = metrics.structure_metrics(df, {"one": "a", "two": "b"}, page_limit=limit)
    for mode, parent in (("one", "a"), ("two", "b")):
        want = metrics.full_metrics(df, pred_parent=parent, styles=False)
        assert {tuple(r) for r in got.where(F.col("mode") == mode).select(*columns).collect()} == {tuple(r) for r in want.select(*columns).collect()}


def test_infonce_of_whole_batches(spark):
    """Null scores, rows without scores and places outside them leave no loss; no lambda runs per score."""
    rows = [([1.0, 2.0], [1]), ([1.0, None], [0]), (None, [0]), ([], [0]), ([3.0], [1]), ([0.5, 0.5, 0.0], [2, 0]), ([2.0], None)]
    df = spark.createDataFrame(rows, "sim array<double>, positives array<int>")
    found = losses.infonce(df, temperature=1.0)
    assert "ArrowEvalPython" in found._jdf.queryExecution().toString()
    want = [math.log(math.exp(1) + math.exp(2)) - 2, math.log(2 * math.exp(0.5) + 1) - 0.5]
    assert found.first().align_nce == pytest.approx(sum(want) / 2)


def test_patch_logits_are_a_stretch_of_one_list(spark, tmp_path):
    """Also of negative ids, as the SQL's remainder has them."""
    lines = [(k, n, 7 * n, 3 + n, 1.0, 5.0, "A") for k in (-500, -3, 0, 5, 101, 10**12) for n in (1, 2, 3)]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    for r in t.patch_scores(spark, str(tmp_path)).collect():
        start = r.node_idx * 31 + r.sample_id
        assert r.sim == [math.fmod(start + 17 * p, 101) / 10 - 5 for p in range(196)]


@pytest.mark.parametrize("limit", [1000, 3])
def test_hybrid_rows(spark, limit):
    """As from one row per candidate, from flags of a window or of joins; pages within the limit join nothing."""
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 8) for _ in range(12)]
    rows = [
        (s, i, rnd.randint(-1, n - 1), rnd.randint(0, 8), [float(rnd.randint(0, 9)) for _ in range(n + 1)])
        for s, n in enumerate(sizes) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "sample_id int, node_idx int, box_parent int, type_idx int, scores array<double>")
    long = df.select("sample_id", "node_idx", F.size("scores").alias("n"), F.posexplode("scores").alias("c", "score")).selectExpr(
        "sample_id", "node_idx", "IF(c = n - 1, -1, c) AS cand_idx", "score"
    )
    want = decode.hybrid_parents(long, df.select("sample_id", "node_idx", "type_idx"), df, 0.9).select("sample_id", "node_idx", "parent_idx")
    got = decode.hybrid_rows(df, 0.9, page_limit=limit)
    assert {tuple(r) for r in got.select("sample_id", "node_idx", "parent_idx").collect()} == {tuple(r) for r in want.collect()}
    assert len({r.parent_idx == r.model_parent for r in got.collect()}) == 2
    if limit == 1000:
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_structure_metrics_of_odd_links(spark):
    """Cycles, null and missing parents and indices with gaps, in pages that lie across batches; no page is gathered in a row."""
    rnd = random.Random(4)
    rows = []
    for s in (None, *range(30)):
        ids = rnd.sample(range(12), rnd.randint(1, 9))
        rows += [(s, i, *[rnd.choice([None, -1, -5, 99, *ids, *ids]) for _ in range(3)], 0, 0) for i in ids]
    df = spark.createDataFrame(rows, "sample_id int, node_idx int, gold_parent int, a int, b int, gold_type int, pred_type int")
    columns = ("sample_id", "parent_p", "parent_r", "parent_f1", "tree_edit")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = metrics.structure_metrics(df, {"one": "a", "two": "b"}, page_limit=1000)
        found = got.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert len(found) == 62
    for mode, parent in (("one", "a"), ("two", "b")):
        want = metrics.full_metrics(df, pred_parent=parent, styles=False, page_limit=1000)
        assert {tuple(r[c] for c in columns) for r in found if r["mode"] == mode} == {tuple(r) for r in want.select(*columns).collect()}


def test_structure_evaluation_reads_the_nodes_twice(spark):
    """For the boxes and what lies around them; the split reads ids."""
    from pagetree.plans import score_queries

    plan = score_queries.structure_evaluation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "l_partkey" in line]
    assert len(scans) == 2
