import json
import random

import pytest
from pyspark.sql import functions as F

from pagetree.operators import html, runs, tree
from pagetree.sources import readers, writers
from pagetree.streaming import ingest


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


TREE = {
    "type": "body", "content": "", "style": None, "bbox": [8, 8, 1264, 758],
    "children": [
        {"type": "div", "content": "", "style": "x:y", "bbox": [0, 0, 640, 400],
         "children": [{"type": "a", "content": "l", "style": None, "bbox": [0, 0, 64, 40], "children": []}]},
        {"type": "p", "content": 'say "hi"', "style": None, "bbox": [0, 400, 1280, 400], "children": []},
    ],
}


@pytest.fixture()
def folder(tmp_path):
    meta = {"bbox": json.dumps(TREE), "score": 3, "scale": [1280, 800], "lang": "en", "hash": "h"}
    whole = json.dumps(meta, indent=2)
    write(tmp_path / "0000" / "page.html", "<p>a</p>")
    write(tmp_path / "0000" / "node_texts.json", json.dumps(["<div></div>", "<p>x</p>"]))
    write(tmp_path / "0000" / "styles.json", json.dumps([{"color": [0, 0, 0, 1], "fontSize": 16, "display": "flex"}, None]))
    write(tmp_path / "0000" / "meta.json", whole)
    write(tmp_path / "0001" / "meta.json", whole[: whole.index('"scale": [') + 10])
    write(tmp_path / "0001" / "page.html", "<p>b</p>")
    return str(tmp_path)


def test_sample_readers(spark, folder):
    pages = readers.read_page_files(spark, folder).orderBy("sample_id").collect()
    assert [(r.sample_id, r.html) for r in pages] == [("0000", "<p>a</p>"), ("0001", "<p>b</p>")]
    nodes = readers.read_node_lists(spark, folder).orderBy("node_idx").collect()
    assert [(r.node_idx, r.node_text) for r in nodes] == [(0, "<div></div>"), (1, "<p>x</p>")]
    styles = readers.read_styles(spark, folder).orderBy("node_idx").collect()
    assert styles[0]["style"].fontSize == 16 and styles[0]["style"].color == [0, 0, 0, 1] and styles[1]["style"] is None
    kinds = readers.list_sample_files(spark, folder)
    assert kinds.where("sample_id = '0000'").count() == 4


def test_meta_tolerates_cut_files(spark, folder):
    got = {r.sample_id: r for r in readers.read_meta(spark, folder).collect()}
    assert got["0000"].scale == [1280, 800] and got["0000"]["_corrupt_record"] is None
    assert got["0001"].score == 3 and json.loads(got["0001"].bbox) == TREE and got["0001"]["_corrupt_record"]


def test_box_tree(spark, folder):
    got = readers.explode_bbox_tree(readers.read_meta(spark, folder)).where("sample_id = '0001'")
    rows = got.orderBy("node_idx").collect()
    assert [(r.tag, r.parent_idx) for r in rows] == [("body", -1), ("div", 0), ("a", 1), ("p", 0)]
    assert rows[3].inner_text == 'say "hi"' and rows[1].inline_style == "x:y"
    assert (rows[1].x2, rows[1].y2) == pytest.approx((112.0, 112.0))


def test_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = [("", None, 1, "image"), ("<p>x</p>", None, 2, "image")]
    spark.createDataFrame(rows, "text string, content string, score int, image string").write.parquet(path)
    corpus = readers.read_pages(spark, path)
    assert "image" not in corpus.columns
    assert sorted((r.html for r in readers.corpus_html(corpus).collect()), key=str) == ["<p>x</p>", None]


def test_run_logs_and_metrics(spark, tmp_path):
    lines = ['{"epoch": 1, "phase": "train", "total": 2.5}', "no json", '{"epoch": 1, "phase": "val", "total": 2.0, "type_acc": 0.5}']
    write(tmp_path / "runA" / "train.log.jsonl", "\n".join(lines))
    write(tmp_path / "runA" / "metrics_val.json", json.dumps({"parent_f1": 0.5}, indent=2))
    log = readers.read_run_log(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.run, r.epoch, r.phase, r.metrics) for r in log] == [
        ("runA", 1, "train", {"total": 2.5}), ("runA", 1, "val", {"total": 2.0, "type_acc": 0.5}),
    ]
    metrics = readers.read_run_metrics(spark, str(tmp_path)).collect()
    assert [(r.run, r.metrics) for r in metrics] == [("runA", {"parent_f1": 0.5})]
    out = str(tmp_path / "log2" / "x")
    writers.write_run_log(readers.read_run_log(spark, str(tmp_path / "runA")), out)
    again = readers.parse_log_lines(spark.read.text(out).select(F.lit("runA").alias("run"), "value"))
    assert again.count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(7, "<ul><li>a</ul>")], "sample_id long, html string")
    nodes = html.page_nodes(df)
    writers.write_nodes(nodes, str(tmp_path / "nodes"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == 2
    writers.write_samples(df, str(tmp_path / "samples"))
    assert spark.read.parquet(str(tmp_path / "samples")).count() == 1
    writers.write_design_json(df, str(tmp_path / "design"))
    writers.write_metrics(df.groupBy().count(), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first()["count"] == 1


def test_streams_resume(spark, tmp_path):
    source, nodes, state = (str(tmp_path / n) for n in ("src", "nodes", "state"))
    pages = lambda a, b: spark.range(a, b).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<div><p>"), F.repeat(F.lit("x"), 300), F.col("id").cast("string"), F.lit("</p></div>")).alias("html")
    )
    pages(0, 3).write.mode("append").parquet(source)
    pages(3, 4).withColumn("html", F.lit("short")).write.mode("append").parquet(source)
    ingest.node_stream(spark, source, nodes, state).awaitTermination()
    assert spark.read.parquet(nodes).count() == 6
    pages(4, 6).write.mode("append").parquet(source)
    ingest.node_stream(spark, source, nodes, state).awaitTermination()
    assert spark.read.parquet(nodes).count() == 10
    kept, state2 = str(tmp_path / "kept"), str(tmp_path / "state2")
    ingest.ingest_stream(spark, source, kept, state2).awaitTermination()
    assert spark.read.parquet(kept).count() == 5
    # the page 4 once more under another id, beside a new one, in a file that is read after a restart
    again = pages(4, 5).withColumn("page_id", F.lit(77).cast("long")).unionByName(pages(6, 7))
    again.coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_stream(spark, source, kept, state2).awaitTermination()
    assert sorted(r.page_id for r in spark.read.parquet(kept).collect()) == [0, 1, 2, 4, 5, 6]
    ingest.node_stream(spark, source, nodes, state).awaitTermination()
    assert spark.read.parquet(nodes).count() == 12


def test_log_stream(spark, tmp_path):
    write(tmp_path / "logs" / "r1" / "a.jsonl", '{"epoch": 1, "phase": "val", "total": 3}\nbad\n{"epoch": 2, "phase": "val", "total": 1.5}\n')
    best = ingest.run_log_stream(spark, str(tmp_path / "logs"))
    query = best.writeStream.format("memory").queryName("best_runs").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.table("best_runs").first()
    assert (row.run, row.phase, row.best_epoch, row.best_total, row.n_records) == ("r1", "val", 2, 1.5, 2)


def test_improvements_come_once_and_in_order(spark, tmp_path):
    rnd = random.Random(4)
    logs, out, state = (str(tmp_path / n) for n in ("logs", "out", "state"))
    records = [
        {"run": run, "epoch": epoch, "phase": phase, "total": None if rnd.random() < 0.1 else round(rnd.random() * 100 / (epoch + 1), 3)}
        for run in ("a", "b") for phase in ("train", "val") for epoch in range(24)
    ]
    for part in range(3):
        for run in ("a", "b"):
            some = [r for r in records if r["run"] == run and r["epoch"] // 8 == part]
            rnd.shuffle(some)
            lines = [json.dumps({k: v for k, v in r.items() if k != "run" and v is not None}) for r in some]
            write(tmp_path / "logs" / run / f"{part}.jsonl", "\n".join([*lines, "no json"]))
        stream = ingest.improvements_stream(spark, logs)
        ingest.write_stream(stream, out, state).awaitTermination()  # a new query on the old state each time
    log = spark.createDataFrame(
        [(r["run"], r["epoch"], r["phase"], {} if r["total"] is None else {"total": r["total"]}) for r in records],
        "run string, seq int, phase string, metrics map<string,double>",
    )
    want = {tuple(r) for r in runs.running_best(log).collect()}
    got = [(r.run, r.phase, r.epoch, r.total) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(want) and set(got) == want


def test_bucketed_nodes_need_no_shuffle(spark, tmp_path):
    nodes = spark.range(400).selectExpr("id div 20 AS sample_id", "CAST(id % 20 AS INT) AS node_idx", "CAST(id % 20 - 1 AS INT) AS parent_idx")
    writers.save_node_table(nodes, "bucketed_nodes", str(tmp_path / "nodes"), buckets=4)
    deep = tree.tree_depth(spark.table("bucketed_nodes"), large_ids=None)
    assert "Exchange" not in deep._jdf.queryExecution().executedPlan().toString()
    assert deep.where("depth = node_idx").count() == 400
    spark.sql("DROP TABLE bucketed_nodes")


def test_corpus_in_file_order(spark, tmp_path):
    """Files by name, rows as they lie, also when a file is read in several splits."""
    for name, start in (("b", 1000), ("a", 0), ("c", 2000)):
        pages = spark.range(start, start + 1000, 1, 1).select(F.col("id"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("html"))
        path = tmp_path / "made" / name
        pages.write.option("parquet.block.size", 65536).parquet(str(path))
        (tmp_path / "corpus").mkdir(exist_ok=True)
        next(path.glob("*.parquet")).rename(tmp_path / "corpus" / f"{name}.parquet")
    files = readers.files_in_order(spark, str(tmp_path / "corpus")).orderBy("place").collect()
    names = [(r.file.rsplit("/", 1)[1], r.place, r.rows) for r in files]
    assert names == [("a.parquet", 0, 1000), ("b.parquet", 1, 1000), ("c.parquet", 2, 1000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        placed = readers.read_pages_in_order(spark, str(tmp_path / "corpus"))
        assert placed.columns == ["id", "html", "place"] and placed.where("place = id").count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_odd_box_trees(spark):
    """No JSON, no type, no children, names with brackets and quotes, and a chain of 60."""
    chain = '{"type":"x","children":[' * 60 + "]}" * 60
    rows = [
        (1, "nope {"), (2, '{"content":"a"}'), (3, '{"type":"a]b[","content":"\\"[[[","bbox":[1,2]}'), (4, None), (5, ""), (6, chain),
        (7, '{"type":"r","children":[{"content":"no type","children":[{"type":"lost"}]},{"type":"kept"},7,null]}'),
    ]
    got = readers.explode_bbox_tree(spark.createDataFrame(rows, "sample_id int, bbox string"))
    found = {}
    for r in got.orderBy("sample_id", "node_idx").collect():
        found.setdefault(r.sample_id, []).append((r.tag, r.parent_idx))
    assert found == {3: [("a]b[", -1)], 6: [("x", i - 1) for i in range(60)], 7: [("r", -1), ("kept", 0)]}
    assert got.where("sample_id = 3").first().inner_text == '"[[['


def test_box_trees_nested_deeper_than_the_parser(spark):
    """Chains around the parser's limit and far above it, the same nodes either way; no JSON gives none."""
    def chain(n):
        return '{"type":"x","bbox":[1,2,3,4],"children":[{"type":"\\"]}","content":"a\\u00e4"},' * n + '{"type":"end"}' + "]}" * n

    texts = {n: chain(n) for n in (3, 499, 500, 501, 20000)}
    broken = {-1: chain(600)[:-1], -2: "[" * 2000, -3: chain(600).replace('"end"', "end"), -4: chain(600).replace('"x"', "null", 1)}
    got = readers.explode_bbox_tree(spark.createDataFrame(list({**texts, **broken}.items()), "sample_id int, bbox string"))
    found = {}
    for r in got.where("sample_id < 1000").orderBy("sample_id", "node_idx").collect():
        found.setdefault(r.sample_id, []).append((r.node_idx, r.parent_idx, r.tag, r.inner_text, r.x1))
    assert set(found) == {3, 499, 500, 501}
    for n, rows in found.items():
        assert len(rows) == 2 * n + 1 and rows[-1][:3] == (2 * n, 2 * n - 2, "end")
        assert all(r[1] == (r[0] - 1 if r[0] % 2 else max(r[0] - 2, -1)) for r in rows[:-1])
    assert found[501][:7] == found[3][:6] + [found[501][6]] and found[501][1][2:4] == ('"]}', "a\u00e4")
    assert got.where("sample_id = 20000").count() == 40001
