"""Queries on sample sets, run logs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as ds
from ..operators import losses, runs
from ..operators import vectors as vec
from ..operators.pages import IDX, SID
from . import tables as t
from .node_queries import SQL_CUT, WITH
from .registry import query, r6

# ---------------------------------------------------------------- splits and samples


def _docs(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", SID)


SQL_RANKED = """
ranked AS (SELECT doc_id AS sample_id, text, lang, source, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents)"""
SQL_SPLIT = f"""{SQL_RANKED},
split AS (
SELECT sample_id, text, CASE WHEN rank < (SELECT floor(count(*) * 0.85::DOUBLE) FROM documents) THEN 'train' ELSE 'val' END AS split
FROM ranked)"""
SQL_DRAWN = """
drawn AS (SELECT doc_id AS sample_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) - 1 AS position FROM documents)"""


@query("prefix_split", f"WITH {SQL_SPLIT} SELECT sample_id, split FROM split")
def prefix_split(spark, sf_dir):
    return ds.prefix_split(_docs(spark, sf_dir))


@query("pick_split", f"WITH {SQL_SPLIT} SELECT sample_id FROM split WHERE split = 'val'")
def pick_split(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return ds.pick_split(docs, ds.prefix_split(docs), "val", fallback="train").select(SID)


@query("hash_split", """SELECT doc_id AS sample_id,
  CASE WHEN CAST('0x' || left(md5(doc_id || ':42'), 8) AS BIGINT)::DOUBLE / 4294967296 < 0.85 THEN 'train' ELSE 'val' END AS split
FROM documents""")
def hash_split(spark, sf_dir):
    return ds.hash_split(_docs(spark, sf_dir))


@query("shuffle", f"WITH {SQL_DRAWN} SELECT * FROM drawn")
def shuffle(spark, sf_dir):
    return ds.shuffle(_docs(spark, sf_dir))


@query("sample_n", f"WITH {SQL_DRAWN} SELECT sample_id, lpad(position::VARCHAR, 4, '0') AS new_name FROM drawn WHERE position < 100")
def sample_n(spark, sf_dir):
    return ds.sample_n(_docs(spark, sf_dir), 100)


@query("copy_sample", f"""WITH {SQL_DRAWN}
SELECT sample_id, lang, source, lpad(position::VARCHAR, 4, '0') AS new_name FROM drawn JOIN documents ON doc_id = sample_id WHERE position < 150""")
def copy_sample(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(SID, "lang", "source")
    return ds.copy_sample(docs, 150)


@query("renumber", f"WITH {SQL_RANKED} SELECT sample_id, CASE WHEN rank < 1000 THEN lpad(rank::VARCHAR, 4, '0') ELSE rank::VARCHAR END AS new_name FROM ranked")
def renumber(spark, sf_dir):
    return ds.renumber(_docs(spark, sf_dir))


@query("first_n", "SELECT doc_id AS sample_id, lang FROM documents WHERE length(text) >= 200 ORDER BY doc_id LIMIT 50")
def first_n(spark, sf_dir):
    """The first 50 pages that are long enough."""
    return ds.first_n(ds.min_length(_docs(spark, sf_dir), html="text"), 50).select(SID, "lang")


@query("collate", f"WITH {SQL_RANKED} SELECT sample_id, rank // 16 AS batch_id, CAST(rank % 16 AS INT) AS slot FROM ranked")
def collate(spark, sf_dir):
    return ds.collate(_docs(spark, sf_dir), 16)


@query("collect_batches", f"""WITH {SQL_RANKED}
SELECT rank // 16 AS batch_id, count(*)::INT AS n, string_agg(sample_id || '/' || lang, ',' ORDER BY rank) AS members FROM ranked GROUP BY 1""")
def collect_batches(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(SID, "lang")
    batches = ds.collect_batches(docs, ds.collate(docs, 16), "lang")
    members = F.transform("batch", lambda s: F.concat_ws("/", s[SID], s["lang"]))
    return batches.select(
        "batch_id", F.size("batch").alias("n"), F.array_join(members, ",").alias("members")
    )


# ---------------------------------------------------------------- duplicates, finished work

@query("dedupe_samples", "SELECT min(doc_id) AS sample_id, any_value(n_chars) AS n_chars FROM documents GROUP BY md5(text)")
def dedupe_samples(spark, sf_dir):
    return ds.dedupe_samples(_docs(spark, sf_dir), "text").select(SID, "n_chars")


@query("split_leakage", f"""WITH {SQL_SPLIT}
SELECT md5(text) AS hash, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val
FROM split GROUP BY 1 HAVING count(DISTINCT split) = 2""")
def split_leakage(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return ds.split_leakage(docs, ds.prefix_split(docs), "text")


@query("skip_existing", "SELECT doc_id AS sample_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, sf_dir):
    """Labelled documents count as finished."""
    done = t.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", SID)
    return ds.skip_existing(_docs(spark, sf_dir).select(SID), done)


@query("discover_samples", f"""{WITH} SELECT sample_id FROM nodes GROUP BY sample_id HAVING count(DISTINCT least(gold_type, 4)) = 5""")
def discover_samples(spark, sf_dir):
    """Pages with nodes of five kinds stand for folders with all five files."""
    kinds = t.nodes(spark, sf_dir).select(SID, F.least("gold_type", F.lit(4)).alias("kind"))
    return ds.discover_samples(kinds)


# ---------------------------------------------------------------- export shapes

@query("pad_array", f"""{WITH}
SELECT sample_id, count(*)::INT AS num_nodes,
  string_agg(gold_parent::VARCHAR, ',' ORDER BY node_idx) || repeat(',-1', 24 - count(*)::INT) AS parents,
  CAST(sum(x1 + y1 + x2 + y2) AS DOUBLE) AS box_sum, 24 AS n_boxes, CAST(count(*) AS DOUBLE) AS mask_sum
FROM nodes GROUP BY sample_id""")
def pad_array(spark, sf_dir):
    """Arrays of 24 slots per page."""
    return _padded_sums(ds.pad_array(t.nodes(spark, sf_dir), 24, "gold_parent"))


def _padded_sums(padded):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return padded.select(
        SID, "num_nodes",
        F.array_join(F.col("parents").cast("array<string>"), ",").alias("parents"),
        total(F.flatten("boxes")).alias("box_sum"),
        F.size("boxes").alias("n_boxes"),
        total(F.col("node_mask")).alias("mask_sum"),
    )


@query("sample_chain", f"""{WITH}, {SQL_CUT},
placed AS (
SELECT c.sample_id, c.new_idx, coalesce(p.new_idx, -1) AS new_parent, n.x1 + n.y1 + n.x2 + n.y2 AS edges
FROM cut c JOIN nodes n USING (sample_id, node_idx) LEFT JOIN cut p ON p.sample_id = c.sample_id AND p.node_idx = c.gold_parent)
SELECT sample_id, count(*)::INT AS num_nodes,
  string_agg(new_parent::VARCHAR, ',' ORDER BY new_idx) || repeat(',-1', 4 - count(*)::INT) AS parents,
  CAST(sum(edges) AS DOUBLE) AS box_sum, 4 AS n_boxes, CAST(count(*) AS DOUBLE) AS mask_sum
FROM placed GROUP BY sample_id""")
def sample_chain(spark, sf_dir):
    """Nodes cut in breadth-first order, renumbered, and padded to arrays."""
    from ..operators import tree

    rows = t.nodes(spark, sf_dir).select(SID, IDX, "gold_parent", "x1", "y1", "x2", "y2")
    return _padded_sums(ds.pad_array(tree.bfs_truncate(rows, 4, "gold_parent", **t.page_sizes(spark, sf_dir)), 4))


@query("training_samples", f"""{WITH}, {t.SQL_TEXTS}, {t.SQL_STYLED}, {t.SQL_PATCHES}, {SQL_CUT},
labels AS (SELECT sample_id, node_idx, count(*) AS n_labels, sum(p) AS places FROM cells WHERE overlap >= 0.3 GROUP BY ALL),
placed AS (
SELECT c.sample_id, c.new_idx, coalesce(p.new_idx, -1) AS new_parent, length(x.node_text) AS chars, n.x1 + n.y1 + n.x2 + n.y2 AS edges,
  t0 + t1 + t2 + t3 + t4 AS reg, v3 AS valid, c0r + c1g + c2b AS color, w0 + w1 + w2 AS w, cls_align, cls_display,
  coalesce(n_labels, 0) AS n_labels, coalesce(places, 0) AS places
FROM cut c JOIN styled n USING (sample_id, node_idx) JOIN texts x USING (sample_id, node_idx) LEFT JOIN labels USING (sample_id, node_idx)
LEFT JOIN cut p ON p.sample_id = c.sample_id AND p.node_idx = c.gold_parent)
SELECT sample_id, count(*)::INT AS num_nodes, string_agg(new_parent::VARCHAR, ',' ORDER BY new_idx) || repeat(',-1', 4 - count(*)::INT) AS parents,
  sum(chars)::BIGINT AS chars, CAST(sum(edges) AS DOUBLE) AS box_sum, CAST(count(*) AS DOUBLE) AS mask_sum, 4 AS width, round(sum(reg), 6) AS reg_sum,
  round(sum(valid), 6) AS valid_sum, round(sum(color), 6) AS color_sum, round(sum(w), 6) AS color_valid_sum, sum(cls_align)::BIGINT AS align_sum,
  sum(cls_display)::BIGINT AS display_sum, sum(n_labels)::BIGINT AS n_labels, sum(places)::BIGINT AS places
FROM placed GROUP BY sample_id""")
def training_samples(spark, sf_dir):
    """Everything that a trainer takes of a page, cut at four nodes, in sums."""
    nodes = t.with_text(t.styles(spark, sf_dir)).select(SID, IDX, "gold_parent", "x1", "y1", "x2", "y2", "style", "node_text")
    found = ds.training_samples(nodes, 4, "gold_parent", **t.page_sizes(spark, sf_dir))

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    return found.select(
        SID, "num_nodes", F.array_join(F.col("parents").cast("array<string>"), ",").alias("parents"),
        F.aggregate("node_texts", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), total(F.flatten("boxes")).alias("box_sum"),
        total("node_mask").alias("mask_sum"), F.size("boxes").alias("width"), r6(total(F.flatten("reg")), "reg_sum"),
        r6(total(F.transform("reg_valid", lambda v: F.get(v, F.lit(3)))), "valid_sum"),
        r6(total(F.flatten(F.transform("color", lambda c: F.transform(c, lambda x, i: F.get(x, i))))), "color_sum"),
        r6(total(F.flatten("color_valid")), "color_valid_sum"),
        F.aggregate("cls_textAlign", F.lit(0).cast("long"), lambda a, x: a + x).alias("align_sum"),
        F.aggregate("cls_display", F.lit(0).cast("long"), lambda a, x: a + x).alias("display_sum"),
        F.aggregate("patches", F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("n_labels"),
        F.aggregate(F.flatten("patches"), F.lit(0).cast("long"), lambda a, x: a + x).alias("places"),
    )


@query("coverage", f"""{WITH}, sizes AS (SELECT sample_id, count(*) AS n FROM nodes GROUP BY sample_id)
SELECT m AS max_nodes, round(avg((n <= m)::INT), 6) AS page_share, round(sum(least(n, m)) / sum(n), 6) AS node_share
FROM sizes, (SELECT unnest([2, 4, 6, 96])::INT AS m) GROUP BY m""")
def coverage(spark, sf_dir):
    shares = ds.coverage(t.nodes(spark, sf_dir), [2, 4, 6, 96])
    return shares.select("max_nodes", r6("page_share", "page_share"), r6("node_share", "node_share"))


# ---------------------------------------------------------------- run logs

WITH_LOG = f"WITH {t.SQL_LOG}"
SQL_LAST = """
last AS (SELECT run, phase, max(seq) AS last_seq, arg_max(struct_pack(v := total), seq).v AS last_total FROM log GROUP BY ALL)"""
SQL_BEST = """
best AS (
SELECT run, phase, seq AS best_seq, total AS best_total, type_acc, n AS n_records FROM (
  SELECT *, count(*) OVER (PARTITION BY run, phase) AS n,
    row_number() OVER (PARTITION BY run, phase ORDER BY coalesce(total, 1e9), seq) AS k FROM log) WHERE k = 1)"""


@query("phase_filter", f"{WITH_LOG} SELECT run, seq FROM log WHERE phase = 'val'")
def phase_filter(spark, sf_dir):
    return runs.phase_filter(t.run_log(spark, sf_dir), "val").select("run", "seq")


@query("has_metric", f"{WITH_LOG} SELECT run, seq, total FROM log WHERE total IS NOT NULL")
def has_metric(spark, sf_dir):
    rows = runs.has_metric(t.run_log(spark, sf_dir), "total")
    return rows.select("run", "seq", runs.metric("total").alias("total"))


@query("last_record", f"{WITH_LOG}, {SQL_LAST} SELECT * FROM last")
def last_record(spark, sf_dir):
    return runs.last_record(t.run_log(spark, sf_dir))


@query("best_record", f"{WITH_LOG}, {SQL_BEST} SELECT run, phase, best_seq, best_total, n_records FROM best")
def best_record(spark, sf_dir):
    return runs.best_record(t.run_log(spark, sf_dir)).drop("best_metrics")


@query("running_best", f"""{WITH_LOG}
SELECT run, phase, seq, total FROM (
  SELECT run, phase, seq, coalesce(total, 1e9) AS total,
    min(coalesce(total, 1e9)) OVER (PARTITION BY run, phase ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM log) WHERE before IS NULL OR total < before""")
def running_best(spark, sf_dir):
    return runs.running_best(t.run_log(spark, sf_dir))


@query("loss_curve", f"""{WITH_LOG}
SELECT phase, epoch, metric, count(*) AS n, round(sum(value), 4) AS value FROM (
  SELECT run, phase, epoch, 'total' AS metric, total AS value FROM log WHERE total IS NOT NULL
  UNION ALL SELECT run, phase, epoch, 'type_acc', type_acc FROM log) GROUP BY ALL""")
def loss_curve(spark, sf_dir):
    points = runs.loss_curve(t.run_log(spark, sf_dir), ["total", "type_acc"])
    return points.groupBy("phase", "epoch", "metric").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")
    )


@query("epoch_mean", f"""{WITH_LOG}
SELECT run, epoch, phase, metric, round(avg(value), 6) AS value FROM (
  SELECT run, phase, epoch, 'total' AS metric, total AS value FROM log WHERE total IS NOT NULL
  UNION ALL SELECT run, phase, epoch, 'type_acc', type_acc FROM log) GROUP BY ALL""")
def epoch_mean(spark, sf_dir):
    steps = runs.loss_curve(t.run_log(spark, sf_dir))
    return losses.epoch_mean(steps).withColumn("value", F.round("value", 6))


SQL_TABLE = f"""{t.SQL_LOG}, {SQL_LAST}, {SQL_BEST}, {t.SQL_RUN_METRICS},
runs AS (SELECT DISTINCT run FROM log),
run_table AS (
SELECT r.run, coalesce(b.n_records, 0) AS epochs, lt.last_total AS final_train_total, lv.last_total AS final_val_total,
  b.best_total AS best_val_total, b.type_acc AS best_val_type_acc, m.parent_f1, m.tree_edit, m.color_de
FROM runs r LEFT JOIN best b ON b.run = r.run AND b.phase = 'val'
LEFT JOIN last lt ON lt.run = r.run AND lt.phase = 'train' LEFT JOIN last lv ON lv.run = r.run AND lv.phase = 'val'
LEFT JOIN run_metrics m ON m.run = r.run)"""


def _run_table(spark, sf_dir):
    log = t.run_log(spark, sf_dir)
    return runs.run_table(log.select("run").distinct(), log, t.run_metrics(spark, sf_dir))


@query("run_table", f"""WITH {SQL_TABLE}
SELECT run, epochs, final_train_total, final_val_total, best_val_total, round(best_val_type_acc, 6) AS best_val_type_acc,
  round(parent_f1, 6) AS parent_f1 FROM run_table""")
def run_table(spark, sf_dir):
    table = _run_table(spark, sf_dir)
    return table.select(
        "run", "epochs", "final_train_total", "final_val_total", "best_val_total",
        r6("best_val_type_acc", "best_val_type_acc"), r6(runs.metric("parent_f1"), "parent_f1"),
    )


def _dash(c: str) -> str:
    return f"coalesce(printf('%.3f', {c}), '—') AS {c}"


@query("run_comparison", f"""WITH {SQL_TABLE}
SELECT run, epochs::VARCHAR AS epochs, {_dash('best_val_total')}, {_dash('best_val_type_acc')}, {_dash('parent_f1')}, {_dash('tree_edit')},
  '—' AS style_reg_mae, {_dash('color_de')} FROM run_table""")
def run_comparison(spark, sf_dir):
    return runs.run_comparison(_run_table(spark, sf_dir))


# engines add up floats in their own order: means are taken to nine decimals, so that a tie of the third is one in both
_DETAILS = (
    ("type_acc", "round(avg(value) / 100, 9)"), ("parent_p", "min(value) / 90"), ("tree_edit", "max(value)"),
    ("cls_display_acc", "round(avg(value) / 200, 9)"),
)


@query("run_details", f"""WITH m AS (
SELECT CAST(user_id AS VARCHAR) AS run, {', '.join(f'{e} AS {c}' for c, e in _DETAILS)} FROM events GROUP BY user_id)
{' UNION ALL '.join(f"SELECT run, {runs.DETAIL_METRICS.index(c)} AS place, '{c}' AS metric, printf('%.3f', {c}) AS value FROM m" + (" WHERE parent_p < 0.05" if c == "parent_p" else "") for c, _ in _DETAILS)}""")
def run_details(spark, sf_dir):
    """Of the nine metrics of the detail table each run has three or four, and one that is not listed."""
    sums = t.table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("v"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    mean = {"type_acc": F.round(F.col("v") / 100, 9), "cls_display_acc": F.round(F.col("v") / 200, 9)}
    values = {**mean, "tree_edit": F.col("hi"), "other": F.col("lo")}
    base = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    low = F.col("lo") / 90
    held = F.when(low < 0.05, F.map_concat(base, F.create_map(F.lit("parent_p"), low))).otherwise(base)
    return runs.run_details(sums.select(F.col("user_id").cast("string").alias("run"), held.alias("metrics")))


@query("ablation_grid", f"""WITH {t.SQL_RUN_METRICS},
long AS (SELECT run, 'parent_f1' AS metric, parent_f1 AS value FROM run_metrics UNION ALL SELECT run, 'tree_edit', tree_edit FROM run_metrics
  UNION ALL SELECT run, 'color_de', color_de FROM run_metrics),
base AS (SELECT min(run) AS run FROM run_metrics)
SELECT l.run, l.metric, round(l.value, 6) AS value, round(b.value, 6) AS baseline, round(l.value - b.value, 6) AS delta
FROM long l JOIN long b ON b.metric = l.metric AND b.run = (SELECT run FROM base) WHERE l.run <> (SELECT run FROM base)""")
def ablation_grid(spark, sf_dir):
    """Every run against the first one by name."""
    per_run = t.run_metrics(spark, sf_dir)
    base = per_run.agg(F.min("run")).first()[0]
    grid = runs.ablation_grid(per_run, base)
    return grid.select("run", "metric", *[r6(c, c) for c in ("value", "baseline", "delta")])


# ---------------------------------------------------------------- vectors

SQL_PARTS = """
parts AS (SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)"""
SQL_MEANS = f"""{SQL_PARTS}, means AS (SELECT label, d, avg(x) AS m FROM parts GROUP BY ALL),
scored AS (
SELECT p.vec_id, m.label, sum(p.x * m.m) / 8 AS score FROM parts p JOIN means m ON m.d = p.d GROUP BY ALL),
weighted AS (
SELECT vec_id, label, score, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM scored),
weights AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS w FROM weighted)"""


def _scored(spark, sf_dir):
    """Label means as the key set, embeddings as queries."""
    vectors = t.table(spark, sf_dir, "embeddings")
    keys = vec.group_means(vectors, "label").withColumnRenamed("label", "key")
    queries = vectors.select("vec_id", "embedding")
    return vec.scaled_dot_scores(queries, keys, "vec_id", "key", 64), keys


@query("vector_norms", f"WITH {SQL_PARTS} SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm FROM parts GROUP BY vec_id")
def vector_norms(spark, sf_dir):
    vectors = vec.vector_norms(t.table(spark, sf_dir, "embeddings"))
    return vectors.select("vec_id", r6("norm", "norm"))


@query("pairwise_cosine", f"""WITH {SQL_PARTS}, norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM parts GROUP BY vec_id),
lists AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.label, a.vec_id, b.vec_id AS other, round(list_inner_product(a.v, b.v) / (na.n * nb.n), 6) + 0.0 AS cosine
FROM lists a JOIN lists b ON a.label = b.label
JOIN norms na ON na.vec_id = a.vec_id JOIN norms nb ON nb.vec_id = b.vec_id""")
def pairwise_cosine(spark, sf_dir):
    """Similarity matrix of each label's vectors."""
    matrix = vec.pairwise_cosine(t.table(spark, sf_dir, "embeddings"), "label", "vec_id", digits=6)
    # looked up by its place: zipping the arrays would make an object of every pair
    pairs = matrix.select("label", "vec_id", "others", F.posexplode("cosine").alias("at", "cosine"))
    return pairs.select("label", "vec_id", F.get("others", "at").alias("other"), "cosine")


@query("scaled_dot_scores", f"WITH {SQL_MEANS} SELECT vec_id, label, round(score, 6) + 0.0 AS score FROM scored")
def scaled_dot_scores(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    flat = scored.select("vec_id", F.inline(F.arrays_zip("key_ids", "scores")))
    return flat.toDF("vec_id", "label", "s").select("vec_id", "label", r6("s", "score"))


@query("attention_weights", f"WITH {SQL_MEANS} SELECT vec_id, label, round(w, 6) AS weight FROM weights")
def attention_weights(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    flat = vec.attention_weights(scored).select("vec_id", F.inline(F.arrays_zip("key_ids", "weights")))
    return flat.toDF("vec_id", "label", "w").select("vec_id", "label", r6("w", "weight"))


@query("softmax_over", f"WITH {SQL_MEANS} SELECT vec_id, label, round(w, 6) AS weight FROM weights")
def softmax_over(spark, sf_dir):
    """The same weights from scores in long form."""
    scored, _ = _scored(spark, sf_dir)
    flat = scored.select("vec_id", F.inline(F.arrays_zip("key_ids", "scores"))).toDF("vec_id", "label", "score")
    return vec.softmax_over(flat, ["vec_id"]).select("vec_id", "label", r6("weight", "weight"))


@query("attend", f"""WITH {SQL_MEANS}
SELECT vec_id, CAST(d AS INT) AS dim, round(sum(w * m), 6) + 0.0 AS value FROM weights JOIN means USING (label) GROUP BY ALL""")
def attend(spark, sf_dir):
    scored, keys = _scored(spark, sf_dir)
    mixed = vec.attend(vec.attention_weights(scored), keys, "vec_id", "key")
    return mixed.select("vec_id", "dim", r6("value", "value"))
