import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagetree.plans import dataset_queries, tables as node_tables  # noqa: F401
from pagetree.plans.registry import QUERIES
from pagetree.operators import dataset as ds
from pagetree.operators import design, ranks, runs
from pagetree.operators import vectors as vec


def test_ranks_of_hot_keys(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", i) for i in range(2000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int")
    plain = ranks.rank_within(df, ["k"], ["i"], "r")
    spread = ranks.rank_within(df, ["k"], ["i"], "r", spread=True)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.select("k", "i", "r").collect()))
    overall = ranks.global_rank(df, ["k", "i"]).orderBy("rank").collect()
    assert [(r.k, r.i) for r in overall] == sorted(rows)
    assert [r["rank"] for r in overall] == list(range(2000))


def ids(spark, n):
    return spark.range(n).select(F.format_string("%04d", "id").alias("sample_id"))


@pytest.mark.parametrize("n, train", [(95, 80), (1, 0), (0, 0)])
def test_prefix_split(spark, n, train):
    split = ds.prefix_split(ids(spark, n))
    assert split.where("split = 'train'").count() == train and split.count() == n
    if n == 95:
        assert split.where("split = 'train'").agg(F.max("sample_id")).first()[0] == "0079"


def test_split_fallbacks(spark):
    samples = ids(spark, 1)
    split = ds.prefix_split(samples, at_least_one=True)
    assert [r.split for r in split.collect()] == ["train"]
    assert ds.pick_split(samples, split, "val").count() == 0
    assert ds.pick_split(samples, split, "val", fallback="train").count() == 1
    assert ds.pick_split(samples, split, "val", fallback="all").count() == 1


def test_hash_split_is_stable_and_near_the_ratio(spark):
    a = {r.sample_id: r.split for r in ds.hash_split(ids(spark, 2000)).collect()}
    b = {r.sample_id: r.split for r in ds.hash_split(ids(spark, 3000)).collect()}
    assert all(b[k] == v for k, v in a.items())
    assert abs(sum(v == "train" for v in a.values()) / 2000 - 0.85) < 0.03


def test_sample_n(spark):
    got = ds.sample_n(ids(spark, 50), 10).collect()
    assert sorted(r.new_name for r in got) == [f"{i:04d}" for i in range(10)]
    assert len({r.sample_id for r in got}) == 10
    assert ds.sample_n(ids(spark, 5), 10).count() == 5
    assert {r.sample_id for r in ds.sample_n(ids(spark, 50), 10, seed=1).collect()} != {r.sample_id for r in got}


def test_dedupe_keeps_the_first_of_hot_copies(spark):
    rows = [(i, "same" if i % 3 else f"p{i}") for i in range(300)]
    got = ds.dedupe_samples(spark.createDataFrame(rows, "sample_id int, html string"))
    kept = {r.sample_id for r in got.collect()}
    assert kept == {1} | {i for i in range(300) if i % 3 == 0}


def test_skip_existing_and_force(spark):
    new, done = ids(spark, 5), ids(spark, 3)
    assert ds.skip_existing(new, done).count() == 2
    assert ds.skip_existing(new, done, force=True).count() == 5


def test_discover_samples(spark):
    rows = [("a", k) for k in "vwxyz"] + [("b", k) for k in "vwxy"] + [("c", "v")] * 5
    got = ds.discover_samples(spark.createDataFrame(rows, "sample_id string, kind string"))
    assert [r.sample_id for r in got.collect()] == ["a"]


def test_pad_array(spark):
    rows = [(0, i, i - 1, 1.0, 2.0, 3.0, 4.0) for i in range(3)]
    schema = "sample_id int, node_idx int, parent_idx int, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame(rows, schema)
    row = ds.pad_array(df, 5).first()
    assert row.parents == [-1, 0, 1, -1, -1] and row.node_mask == [1.0, 1.0, 1.0, 0.0, 0.0]
    assert row.boxes == [[1.0, 2.0, 3.0, 4.0]] * 3 + [[0.0] * 4] * 2 and row.num_nodes == 3
    with pytest.raises(Exception, match="truncate first"):
        ds.pad_array(df, 2).collect()


def test_project_meta_defaults(spark):
    df = spark.createDataFrame([(None, None)], "score int, lang string")
    row = ds.project_meta(df).first()
    assert row.asDict() == {"bbox": "", "score": 0, "scale": [], "lang": "", "hash": ""}


def test_coverage(spark):
    rows = [(s, i) for s, n in enumerate([1, 4, 10]) for i in range(n)]
    got = {r.max_nodes: r for r in ds.coverage(spark.createDataFrame(rows, "sample_id int, node_idx int"), [4, 96]).collect()}
    assert got[4].page_share == pytest.approx(2 / 3) and got[4].node_share == pytest.approx(9 / 15)
    assert got[96].page_share == 1.0


# ---------------------------------------------------------------- runs


def log(spark, rows):
    return spark.createDataFrame(rows, "run string, seq long, epoch int, phase string, metrics map<string,double>")


def test_running_best_over_stretches(spark):
    rnd = random.Random(4)
    values = [(i * 30_000, round(rnd.uniform(0, 9), 2)) for i in range(40)]
    df = log(spark, [("r", s, 0, "val", {"total": v}) for s, v in values])
    want, low = [], None
    for s, v in values:
        if low is None or v < low:
            want.append((s, v))
            low = v
    assert [(r.seq, r.total) for r in runs.running_best(df).orderBy("seq").collect()] == want


def test_best_record_counts_missing_as_large(spark):
    df = log(spark, [("r", 0, 1, "val", {}), ("r", 1, 2, "val", {"total": 2.0}), ("r", 2, 3, "val", {"total": 2.0})])
    best = runs.best_record(df).first()
    assert (best.best_seq, best.best_total, best.n_records) == (1, 2.0, 3)


def test_run_comparison_rounds_like_c_and_marks_gaps(spark):
    df = log(spark, [("a", 0, 1, "val", {"total": 0.0075, "type_acc": 0.5})])
    listed = spark.createDataFrame([("a",), ("b",)], "run string")
    final = spark.createDataFrame([("a", {"parent_f1": 0.4577})], "run string, metrics map<string,double>")
    got = {r.run: r for r in runs.run_comparison(runs.run_table(listed, df, final)).collect()}
    assert got["a"].best_val_total == f"{0.0075:.3f}" and got["a"].parent_f1 == "0.458"
    assert got["a"].tree_edit == "—" and got["b"].best_val_total == "—" and got["b"].epochs == "0"


# ---------------------------------------------------------------- vectors and design


def test_pairwise_cosine_in_blocks(spark):
    df = spark.createDataFrame([(0, k, [1.0, float(k)]) for k in range(7)], "page int, k int, embedding array<double>")
    whole = vec.pairwise_cosine(df, "page", "k").orderBy("k").collect()
    assert whole[0].others == list(range(7)) and whole[0].cosine[1] == pytest.approx(1 / 2**0.5)
    parts = {}
    for r in vec.pairwise_cosine(df, "page", "k", block=2).collect():
        parts.setdefault(r.k, []).extend(zip(r.others, r.cosine))
    assert {k: sorted(p) for k, p in parts.items()} == {r.k: list(zip(r.others, r.cosine)) for r in whole}


def test_scaled_dot_and_attend_in_blocks(spark):
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "q int, embedding array<double>")
    keys = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "k int, vector array<double>")
    results = []
    for block in (100, 2):
        scored = vec.attention_weights(vec.scaled_dot_scores(asked, keys, "q", "k", 2, block=block))
        mixed = {(r.q, r.dim): round(r.value, 9) for r in vec.attend(scored, keys, "q", "k", block=block).collect()}
        results.append(({r.q: (r.key_ids, r.scores) for r in scored.collect()}, mixed))
    assert results[0] == results[1] and results[0][0][0][0] == list(range(9))


def test_zero_vector_has_no_similarity(spark):
    df = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 0.0])], "page int, k int, embedding array<double>")
    assert vec.pairwise_cosine(df, "page", "k").orderBy("k").first().cosine == [0.0, 0.0]


def test_design_tree(spark):
    texts = [
        '<div id="container" style="background:#ffffff">',
        '<p style="color:rgb(0, 0, 0)">Hello</p>',
        '<span class="label">World</span>',
    ]
    boxes = [(0, 0, 224, 224), (10, 10, 100, 30), (10, 40, 100, 60)]
    rows = [(1, i, t, [0, 2, 2][i], [-1, 0, 0][i], *map(float, b)) for i, (t, b) in enumerate(zip(texts, boxes))]
    df = spark.createDataFrame(
        rows, "sample_id int, node_idx int, node_text string, type_idx int, parent_idx int, x1 double, y1 double, x2 double, y2 double"
    )
    flat = design.design_nodes(df)
    roots = json.loads(design.to_design_tree(flat).first().design)
    assert len(roots) == 1 and roots[0]["id"] == "node_0" and roots[0]["name"] == "div#container"
    assert [c["id"] for c in roots[0]["children"]] == ["node_1", "node_2"]
    assert roots[0]["fills"][0]["type"] == "SOLID" and "children" not in roots[0]["children"][0]
    assert roots[0]["children"][0]["absoluteBoundingBox"] == {"x": 10.0, "y": 10.0, "width": 90.0, "height": 20.0}
    back = {r.id: (r.parent, r.place) for r in design.read_design_tree(design.to_design_tree(flat)).collect()}
    assert back == {"node_0": (None, 0), "node_1": ("node_0", 0), "node_2": ("node_0", 1)}


def test_design_tree_of_deep_wide_and_cyclic_pages():
    n = 5000
    chain = design.nest(list(range(n)), [i - 1 for i in range(n)], [f'{{"id":"{i}"}}' for i in range(n)])
    assert chain.count('"children"') == n - 1 and chain.startswith('[{"id":"0","children":[{"id":"1"') and chain.endswith("]}" * (n - 1) + "]")
    star = json.loads(design.nest(list(range(n)), [-1] + [0] * (n - 1), [f'{{"id":"{i}"}}' for i in range(n)]))
    assert [c["id"] for c in star[0]["children"]] == [str(i) for i in range(1, n)]
    cyclic = json.loads(design.nest([0, 1, 2, 3], [-1, 2, 1, 0], [f'{{"id":"{i}"}}' for i in range(4)]))
    assert cyclic == [{"id": "0", "children": [{"id": "3"}]}]
    assert design.nest([], [], []) == "[]"


def test_pad_array_takes_the_cut(spark):
    from pagetree.operators import tree

    rows = [(1, i, (i - 1) // 2 if i else -1, 0.0, 0.0, float(i), 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "sample_id int, node_idx int, parent_idx int, x1 double, y1 double, x2 double, y2 double")
    got = ds.pad_array(tree.bfs_truncate(df, 4), 4).first()
    assert (got.num_nodes, got.parents, got.node_mask) == (4, [-1, 0, 0, 1], [1.0] * 4)


def test_heuristic_predict(spark):
    rows = [(1, 0, "<div>", 0.0, 0.0, 9.0, 9.0), (1, 1, "<p>a</p>", 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "sample_id int, node_idx int, node_text string, x1 double, y1 double, x2 double, y2 double")
    got = design.heuristic_predict(df).orderBy("node_idx").collect()
    assert [(r.type_idx, r.parent_idx) for r in got] == [(0, -1), (2, 0)]
    loose = design.heuristic_predict(df, tag_mode="reference").orderBy("node_idx").collect()
    assert loose[1].type_idx == 0


def test_sample_is_the_head_of_the_shuffle(spark):
    """Thresholds draw the same ids and names as ranking all of them."""
    ids = spark.range(3000).withColumnRenamed("id", "sample_id")
    order = {r.sample_id: r.position for r in ds.shuffle(ids, seed=7).collect()}
    for n in (0, 1, 40, 2900, 3000, 5000):
        got = {r.sample_id: r.new_name for r in ds.sample_n(ids, n, seed=7).collect()}
        assert got == {i: f"{p:04d}" for i, p in order.items() if p < n}
    assert ds.sample_n(ids.limit(0), 5).count() == 0


def test_corpus_to_samples(spark):
    """Raw pages to padded arrays: one page is cut breadth first, one node has neither box nor style."""
    pages = spark.createDataFrame([(1, "<div><p>a</p><ul><li>b</li></ul></div><img>"), (2, "<h1>Hi</h1>")], "sample_id int, html string")
    style = "struct<backgroundColor:array<double>,color:array<double>,borderColor:array<double>,borderRadius:double,borderWidth:double,opacity:double,fontSize:double,fontWeight:int,textAlign:string,display:string>"
    look = ([1.0, 0.5, 0.0, 1.0], None, None, 25.0, None, 1.0, 32.0, 450, "center", "flex")
    layout = spark.createDataFrame(
        [(1, 0, 0.0, 0.0, 32.0, 16.0, look), (1, 1, 16.0, 16.0, 32.0, 32.0, None), (2, 0, 0.0, 0.0, 224.0, 224.0, look)],
        f"sample_id int, node_idx int, x1 double, y1 double, x2 double, y2 double, style {style}",
    )
    one, two = ds.corpus_samples(pages, layout, max_nodes=4).orderBy("sample_id").collect()
    assert (one.num_nodes, two.num_nodes) == (4, 1)
    assert one.node_texts == ["<div></div>", "<img></img>", "<p>a</p>", "<ul></ul>"] and one.parents == [-1, -1, 0, 0]
    assert one.boxes == [[0.0, 0.0, 32.0, 16.0], [0.0] * 4, [16.0, 16.0, 32.0, 32.0], [0.0] * 4] and one.node_mask == [1.0] * 4
    assert one.patches == [[0, 1], [], [15], []] and one.cls_textAlign[0] == 2 and one.reg[0] == pytest.approx([0.5, 0, 1, 0.5, 0.5])
    assert one.reg_valid[1] == [0.0] * 5 and one.color[0][0] == [1.0, 0.5, 0.0, 1.0] and one.color_valid[2] == [0.0] * 3
    assert two.parents == [-1] * 4 and two.node_mask == [1.0, 0.0, 0.0, 0.0] and len(two.patches[0]) == 196 and two.patches[1:] == [[], [], []]
    assert ds.corpus_samples(pages.limit(0), layout).count() == 0


def test_attention_grid_of_the_first_nodes(spark):
    df = spark.createDataFrame([(0, i, [1.0, 4.0]) for i in range(3)], "sample_id int, node_idx int, sim array<double>")
    assert runs.attention_grid(df).count() == 6
    shown = runs.attention_grid(df, k=2).collect()
    assert sorted((r.node_idx, r.col, round(r.heat, 6)) for r in shown) == [(0, 0, 0.25), (0, 1, 1.0), (1, 0, 0.25), (1, 1, 1.0)]


def test_pairwise_cosine_multiplies_blocks(spark):
    """Two blocks meet in one call; null vectors have no similarity, unlike lengths no value."""
    rows = [(0, 1, [3.0, 4.0]), (0, 2, None), (0, 3, [1.0, None]), (0, 4, [1.0]), (0, 5, [4.0, 3.0]), (1, None, [2.0]), (1, 7, [])]
    df = spark.createDataFrame(rows, "page int, k int, embedding array<double>")
    found = vec.pairwise_cosine(df, "page", "k")
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    got = {(r.page, r.k): (r.others, r.cosine) for r in found.collect()}
    assert got[0, 1] == ([1, 2, 3, 4, 5], [1.0, 0.0, 0.0, None, pytest.approx(0.96)])
    assert got[0, 2][1] == got[0, 3][1] == [0.0] * 5 and got[0, 4][1] == [None, 0.0, 0.0, 1.0, None]
    assert got[1, None] == ([None, 7], [1.0, 0.0]) and got[1, 7][1] == [0.0, 0.0]


def shuffled_records(spark):
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = store.stageList(None, False, False, quantiles, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairwise_cosine_shuffles_a_vector_once(spark):
    """In a group of 11 or 43 blocks, however many pairs these make."""
    sent = []
    for n in (64, 256):
        df = spark.createDataFrame([(0, k, [1.0, float(k)]) for k in range(n)], "page int, k int, embedding array<double>")
        before = shuffled_records(spark)
        found = vec.pairwise_cosine(df, "page", "k", block=8)
        assert found.select(F.sum(F.size("others"))).first()[0] == n * n
        sent.append(shuffled_records(spark) - before)
    assert sent[0] < 4 * 64 and sent[1] < 4 * 256


def test_pairwise_cosine_of_small_and_large_groups(spark):
    """One block or many: the same pairs, also for null keys, groups and vectors and unlike lengths."""
    rows = [(g, k, [float(k % 5 - 2), float(g), 1.0]) for g, n in ((0, 3), (1, 20), (2, 1)) for k in range(n)]
    rows += [(1, None, [2.0, 1.0, 0.0]), (1, 90, None), (1, 91, [1.0, None, 2.0]), (1, 92, [1.0]), (1, 93, []), (1, 94, [0.0] * 3), (None, 1, [1.0])]
    df = spark.createDataFrame(rows, "page int, k int, embedding array<double>")
    for digits in (None, 6):
        found = []
        for block in (1024, 4, 1):
            pairs = {}
            for r in vec.pairwise_cosine(df, "page", "k", block=block, digits=digits).collect():
                for o, c in zip(r.others, r.cosine):
                    assert (r.page, r.k, o) not in pairs
                    pairs[r.page, r.k, o] = c
            found.append(pairs)
        assert found[0] == found[1] == found[2] and len(found[0]) == 9 + 26 * 26 + 1
    assert vec.pairwise_cosine(df.limit(0), "page", "k").count() == 0


def test_rounded_cosines_are_those_of_sums_in_order():
    """A matrix product adds up in another order; halves go away from zero."""
    rng = np.random.default_rng(5)

    def block(rows):
        norms = np.sqrt(np.array([sum(x * x for x in r) for r in rows]))
        return rows, np.full(len(rows), rows.shape[1]), norms

    ones, unit = np.ones((1, 16)), np.eye(16)[:1]
    got = vec._similarities(block(np.vstack([unit, -unit, 0 * unit])), block(ones), 1).to_pylist()
    assert got == [0.3, -0.3, 0.0] and str(got[2]) == "0.0"
    for a in (rng.normal(size=(90, 64)), rng.integers(-1, 2, size=(90, 64)).astype(float), rng.normal(size=(90, 7)) * 1e120):
        left, right = block(a), block(a[::-1])
        exact = vec._similarities(left, right).to_numpy()
        for digits in (1, 2, 6, 14):
            whole = np.trunc(exact * 10.0**digits)
            whole += np.sign(exact) * (np.abs(exact * 10.0**digits - whole) >= 0.5)
            assert np.array_equal(vec._similarities(left, right, digits).to_numpy(), whole / 10.0**digits, equal_nan=True)


def test_run_details_in_any_order(spark, tmp_path):
    """A mean at a tie of the third decimal: the order of adding up must not decide it."""
    values = [553.41, 252.48, 496.74, 583.44, 275.63, 26.54, 169.69, 335.27]
    found = []
    for name, order in (("a", values), ("b", values[::-1])):
        events = spark.createDataFrame([(7, v) for v in order], "user_id long, value double").coalesce(1)
        events.write.parquet(str(tmp_path / name / "events.parquet"))
        found.append({r.metric: r.value for r in entry.queries()["run_details"](spark, str(tmp_path / name)).collect()})
    assert found[0] == found[1] and set(found[0]) == {"type_acc", "tree_edit", "cls_display_acc"}


def test_heat_sums_are_those_of_the_grid(spark):
    """Summed a batch at a time: nulls, empty rows, unlike lengths, logits."""
    sims = [[1.0, 4.0, None] + [2.0] * 13, [0.0] * 3, [], None, [None, None], [-1.0, 0.5, 3.0, None]]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(sims)], "sample_id int, node_idx int, sim array<double>").repartition(3)
    for logits in (False, True):
        shown = df.withColumn("sim", F.transform("sim", lambda x: 1 / (1 + F.exp(-x)))) if logits else df
        want = runs.attention_grid(shown).groupBy("row", "col").agg(F.count("*").alias("n"), F.sum("heat").alias("heat"))
        got = {(r.row, r.col): (r.n, r.heat) for r in runs.heat_sums(df, logits=logits).collect()}
        assert got == {(r.row, r.col): (r.n, r.heat and pytest.approx(r.heat)) for r in want.collect()} and len(got) == 16
    plan = entry.queries()["attention_grid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_node_view_keeps_tasks_small(spark, monkeypatch):
    """More lines than a task should take make more partitions, not larger ones; rows stay the same."""
    folder = "/root/testdata/sf0.001"
    want = node_tables.nodes(spark, folder)
    monkeypatch.setattr(node_tables, "TASK_ROWS", 100)
    got = node_tables.nodes(spark, folder)
    lines = node_tables.table(spark, folder, "lineitem").count()
    assert got.rdd.getNumPartitions() == -(-lines // 100)
    assert got.exceptAll(want).count() == 0 and got.count() == lines


def test_training_samples_read_the_lines_once(spark):
    plan = QUERIES["training_samples"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_design_trees_are_read_in_parts(spark, monkeypatch):
    """Nodes of a batch of documents leave as columns, a bounded number at a time."""
    import json

    import pyarrow as pa

    monkeypatch.setattr(design, "READ_ROWS", 3)
    documents = [[{"id": "a", "name": "x", "type": "FRAME", "children": [{"id": "b"}, {"id": "c"}]}, {"id": "d"}], [], [{"id": "e"}, {"id": "f"}], [{"id": "g"}]]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, None, 9], pa.int64()), pa.array([json.dumps(d) for d in documents])], names=["sample_id", "design"])
    parts = list(design._flatten([batch]))
    assert [p.num_rows for p in parts] == [4, 3]
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert rows[:2] == [(7, "a", "x", "FRAME", None, 0), (7, "d", None, None, None, 1)]
    assert set(rows[2:4]) == {(7, "b", None, None, "a", 0), (7, "c", None, None, "a", 1)}
    assert rows[4:] == [(None, "e", None, None, None, 0), (None, "f", None, None, None, 1), (9, "g", None, None, None, 0)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "sample_id int, design string")
    assert {(r.sample_id, r.id, r.parent, r.place) for r in design.read_design_tree(df).collect()} >= {(0, "b", "a", 0), (2, "f", None, 1)}


def test_a_design_row_searches_its_text_once_for_a_color(spark):
    """Fills are made once, not again for the empty strokes."""
    rows = [(0, i, t, 0, -1, 0.0, 0.0, 1.0, 1.0) for i, t in enumerate(('<a style="color:#333">', "<a>", None))]
    df = spark.createDataFrame(rows, "sample_id int, node_idx int, node_text string, type_idx int, parent_idx int, x1 double, y1 double, x2 double, y2 double")
    flat = design.design_nodes(df)
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("background") <= 8
    assert [(len(r.fills), r.strokes) for r in flat.orderBy("node_idx").collect()] == [(1, []), (0, []), (0, [])]
