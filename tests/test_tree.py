import random

import pytest
from pyspark.sql import functions as F

from pagetree.operators import metrics, tree
from pagetree.operators.pages import cut as pages_cut
from pagetree.operators.ranks import rank_within

SCHEMA = "sample_id int, node_idx int, parent_idx int, pred_parent int, keep boolean"
# 10000: every page is gathered; 12: larger pages go through joins; 0: all pages do
LIMITS = [10000, 12, 0]


def pages(seed=1, n_pages=30, cyclic=True):
    rnd = random.Random(seed)
    made = {}
    for s in range(n_pages):
        n = rnd.randint(1, 30)
        rows = []
        for i in range(n):
            gold = rnd.randint(-1, n) if cyclic and s % 3 == 0 else rnd.randint(-1, i - 1)
            pred = gold if rnd.random() < 0.7 else rnd.randint(-1, n - 1)
            rows.append((s, i, gold, pred, rnd.random() < 0.5))
        made[s] = rows
    return made


@pytest.fixture(scope="module")
def made():
    return pages()


@pytest.fixture(scope="module")
def df(spark, made):
    return spark.createDataFrame([r for rows in made.values() for r in rows], SCHEMA).cache()


def parents_of(rows, column=2):
    n = len(rows)
    return [r[column] if 0 <= r[column] < n else -1 for r in rows]


def walk(parents, i):
    """Node and its ancestors up to the root; None on a cycle."""
    path = [i]
    while parents[i] >= 0:
        i = parents[i]
        if i in path:
            return None
        path.append(i)
    return path


def collect(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("limit", LIMITS)
def test_depth(df, made, limit):
    want = set()
    for s, rows in made.items():
        p = parents_of(rows)
        for i in range(len(rows)):
            path = walk(p, i)
            want.add((s, i, None if path is None else len(path) - 1, path is None))
    got = tree.tree_depth_raw(df, page_limit=limit)
    assert collect(got, "sample_id", "node_idx", "depth", "is_cyclic") == want


def test_depth_clamp(spark):
    chain = spark.createDataFrame([(0, i, i - 1) for i in range(40)], "sample_id int, node_idx int, parent_idx int")
    assert tree.tree_depth(chain).agg(F.max("depth")).first()[0] == 31
    assert tree.tree_depth_raw(chain, page_limit=5).agg(F.max("depth")).first()[0] == 39


def test_depth_and_siblings_of_the_demo_page(spark):
    demo = spark.createDataFrame(
        [(0, i, p) for i, p in enumerate([-1, 0, -1, 2, 2, 2])], "sample_id int, node_idx int, parent_idx int"
    )
    depth = tree.tree_depth(demo).orderBy("node_idx").collect()
    assert [r.depth for r in depth] == [0, 1, 0, 1, 1, 1]
    place = tree.sibling_index(demo).orderBy("node_idx").collect()
    assert [r.sibling_idx for r in place] == [0, 0, 1, 0, 1, 2]


@pytest.mark.parametrize("limit", LIMITS)
def test_sibling_index(df, made, limit):
    want = set()
    for s, rows in made.items():
        seen = {}
        for r in rows:
            key = max(r[2], -1)
            want.add((s, r[1], seen.get(key, 0)))
            seen[key] = seen.get(key, 0) + 1
    assert collect(tree.sibling_index(df, page_limit=limit), "sample_id", "node_idx", "sibling_idx") == want


@pytest.mark.parametrize("limit", LIMITS)
def test_nearest_kept_ancestor(df, made, limit):
    want = set()
    for s, rows in made.items():
        p = parents_of(rows)
        for i in range(len(rows)):
            at, steps = p[i], 0
            while at >= 0 and not rows[at][4] and steps <= len(rows):
                at, steps = p[at], steps + 1
            want.add((s, i, at if at >= 0 and rows[at][4] else -1))
    got = tree.nearest_kept_ancestor(df, page_limit=limit)
    assert collect(got, "sample_id", "node_idx", "kept_parent") == want


@pytest.mark.parametrize("limit", LIMITS)
def test_subtree_size(df, made, limit):
    want = set()
    for s, rows in made.items():
        p = parents_of(rows)
        sizes = {}
        for i in range(len(rows)):
            for a in walk(p, i) or ():
                sizes[a] = sizes.get(a, 0) + 1
        want |= {(s, i, n) for i, n in sizes.items()}
    assert collect(tree.subtree_size(df, page_limit=limit), "sample_id", "node_idx", "subtree_size") == want


def bfs(parents):
    order, level = [], [i for i, p in enumerate(parents) if p < 0]
    while level:
        order += level
        level = [c for n in level for c, p in enumerate(parents) if p == n]
    return order


@pytest.mark.parametrize("limit", LIMITS)
def test_bfs_truncate(df, made, limit):
    want = set()
    for s, rows in made.items():
        p = parents_of(rows)
        kept = list(range(len(rows))) if len(rows) <= 10 else bfs(p)[:10]
        new = {at: i for i, at in enumerate(kept)}
        want |= {(s, at, i, new.get(p[at], -1)) for at, i in new.items()}
    got = tree.bfs_truncate(df, 10, page_limit=limit)
    assert collect(got, "sample_id", "node_idx", "new_idx", "new_parent") == want
    # a cut page keeps the parent of every kept node
    assert got.where("new_parent >= new_idx and sample_id % 3 > 0").count() == 0


@pytest.mark.parametrize("limit", LIMITS)
def test_layout(df, made, limit):
    want = set()
    for s, rows in made.items():
        p = parents_of(rows)
        layers = {}
        for i in bfs(p):
            layers.setdefault(len(walk(p, i)) - 1, []).append(i)
        for d, layer in layers.items():
            want |= {(s, i, round((k + 1) / (len(layer) + 1), 9), float(-d)) for k, i in enumerate(layer)}
    got = tree.tree_layout(df, page_limit=limit).withColumn("x", F.round("x", 9))
    assert collect(got, "sample_id", "node_idx", "x", "y") == want


def edits(gold, pred):
    """Child sets compared from the root down."""
    total, todo = 0, [-1]
    while todo:
        at = todo.pop()
        a = {i for i, p in enumerate(gold) if p == at}
        b = {i for i, p in enumerate(pred) if p == at}
        total += len(a ^ b)
        todo += a & b
    return total


@pytest.mark.parametrize("limit", LIMITS)
def test_tree_edit_distance(df, made, limit):
    want = {(s, edits(parents_of(r), parents_of(r, 3))) for s, r in made.items()}
    got = tree.tree_edit_distance(df, "parent_idx", "pred_parent", page_limit=limit)
    assert collect(got, "sample_id", "tree_edit") == want
    back = tree.tree_edit_distance(df, "pred_parent", "parent_idx", page_limit=limit)
    assert collect(back, "sample_id", "tree_edit") == want
    same = tree.tree_edit_distance(df.withColumn("p", F.col("parent_idx")), "parent_idx", "p", page_limit=limit)
    assert same.agg(F.max("tree_edit")).first()[0] == 0


@pytest.mark.parametrize("limit", [10000, 12])
def test_full_metrics_takes_large_pages(df, made, limit):
    rows = df.withColumns({"gold_type": F.lit(1), "pred_type": F.when(F.col("keep"), 1).otherwise(2)})
    got = metrics.full_metrics(rows, "parent_idx", "pred_parent", styles=False, page_limit=limit)
    found = {r.sample_id: r for r in got.collect()}
    for s, page in made.items():
        right = sum(r[2] == r[3] for r in page) / len(page)
        assert found[s].parent_f1 == pytest.approx(right)
        assert found[s].parent_p == found[s].parent_r
        assert found[s].type_acc == pytest.approx(sum(r[4] for r in page) / len(page))
        assert found[s].tree_edit == edits(parents_of(page), parents_of(page, 3))


def test_reindex_climbs_over_dropped_nodes(spark):
    nodes = spark.createDataFrame([(0, i, i - 1) for i in range(6)], "sample_id int, node_idx int, parent_idx int")
    kept = spark.createDataFrame([(0, 0, 0), (0, 3, 1), (0, 5, 2)], "sample_id int, node_idx int, new_idx int")
    for limit in (100, 2):
        got = tree.reindex_parents(nodes, kept, page_limit=limit)
        assert collect(got, "node_idx", "new_idx", "new_parent") == {(0, 0, -1), (3, 1, 0), (5, 2, 1)}


def test_root_nodes_and_gaps(spark):
    rows = [(0, 0, -1), (0, 2, 0), (0, 3, 1), (0, 7, 2)]  # node 1 is missing
    nodes = spark.createDataFrame(rows, "sample_id int, node_idx int, parent_idx int")
    assert collect(tree.root_nodes(nodes), "node_idx") == {(0,), (3,)}
    for limit in (100, 2):
        got = tree.tree_depth(nodes, page_limit=limit)
        assert collect(got, "node_idx", "depth") == {(0, 0), (2, 1), (3, 0), (7, 2)}


def test_preorder_of_long_and_broad_pages(spark, monkeypatch):
    """A chain of 4,000 nodes, whose numbers run down its steps, and a star of 70,000, whose siblings
    follow each other across stretches of 65,536 places; rounds grow with the logarithm."""
    rounds = []
    monkeypatch.setattr(tree, "cut", lambda df: rounds.append(1) or pages_cut(df))
    chain = spark.range(4000).selectExpr("0 AS sample_id", "CAST(id AS INT) AS node_idx", "CAST(IF(id = 3999, -1, id + 1) AS INT) AS parent_idx")
    star = spark.range(70_000).selectExpr("1 AS sample_id", "CAST(id AS INT) AS node_idx", "CAST(IF(id = 5, -1, 5) AS INT) AS parent_idx")
    found = tree.preorder(chain.union(star)).cache()
    assert found.where("sample_id = 0 AND depth = 3999 - node_idx AND preorder = depth").count() == 4000
    assert found.where("sample_id = 1 AND depth = CAST(node_idx <> 5 AS INT)").count() == 70_000
    assert found.where("sample_id = 1 AND preorder = IF(node_idx = 5, 0, IF(node_idx < 5, node_idx + 1, node_idx))").count() == 70_000
    assert len(rounds) <= 2 * 13 + 4


def test_cut_of_a_chain(spark):
    chain = spark.range(300).selectExpr("0 AS sample_id", "CAST(id AS INT) AS node_idx", "CAST(IF(id = 299, -1, id + 1) AS INT) AS parent_idx")
    cut = tree.bfs_truncate(chain, 3, page_limit=3)
    assert collect(cut, "node_idx", "new_idx", "new_parent") == {(299, 0, -1), (298, 1, 0), (297, 2, 1)}


@pytest.mark.parametrize("cyclic", [False, True])
def test_preorder_against_a_walk(spark, cyclic):
    made = pages(9, 12, cyclic)
    df = spark.createDataFrame([r for rows in made.values() for r in rows], SCHEMA)
    want = set()
    for s, rows in made.items():
        parents, number = parents_of(rows), 0
        stack = [(i, 0) for i in reversed(range(len(rows))) if parents[i] < 0]
        while stack:
            i, depth = stack.pop()
            want.add((s, i, depth, number))
            number += 1
            stack += [(c, depth + 1) for c in reversed(range(len(rows))) if parents[c] == i]
    assert collect(tree.preorder(df), "sample_id", "node_idx", "depth", "preorder") == want


def rows_shuffled(spark, run):
    """Rows that the stages of a run have written for others to read."""
    sc = spark.sparkContext
    listed = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    before = {listed().apply(i).stageId() for i in range(listed().size())}
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = listed()
    return sum(s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size())) if s.stageId() not in before)


def test_large_pages_send_their_nodes_a_few_times(spark):
    """2,000 nodes with random parents: a node is sent only as long as others hang on it, and ranks
    within a key take one exchange."""
    rnd = random.Random(4)
    rows = [(s, i, rnd.randrange(i) if i and rnd.random() < 0.85 else -1) for s in range(4) for i in range(500)]
    df = pages_cut(spark.createDataFrame(rows, "sample_id int, node_idx int, parent_idx int"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = rows_shuffled(spark, lambda: tree.preorder(df).write.format("noop").mode("overwrite").save())
        ranked = rows_shuffled(spark, lambda: rank_within(df, ["sample_id"], ["node_idx"], "r", True).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert cut < 16 * len(rows)
    assert ranked < 1.2 * len(rows)


def test_ranks_run_on_across_partitions(spark):
    """One key holds most rows, so it fills several partitions; null is a key too."""
    rows = [(k, o) for k, n in ((None, 3), (1, 2), (2, 5000), (3, 1)) for o in range(n)]
    df = spark.createDataFrame(rows, "k int, o int").repartition(7)
    assert collect(rank_within(df, ["k"], ["o"], "r", True).where("r <> o"), "k", "o", "r") == set()
    assert rank_within(df, ["k"], ["o"], "r", True).count() == len(rows)
