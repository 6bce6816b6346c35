"""The registered queries of this subpackage and the SQL they are checked against.

Each query applies one operator, with the parameters meant for production, to its whole table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, ordinal
from .backoff import score_texts
from .balltree import top_k, usable, whole_numbers
from .minhash import NearDuplicates, near_duplicates
from .mixing import mix_sources, sized
from .outliers import quality_rules
from .packing import pack
from .repair import repair
from .rollups import TokenRollup, delete, insert, revise
from .spelling import count_words, letter_runs, spelling_variants
from .stage import shared_folder, staged
from .substrings import RepeatSettings, remove_repeats
from .winnow import dedup_lines
from .words import n_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER_WORDS_SQL = _WORDS_SQL.replace(
    "coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_minhash",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_LOWER_WORDS_SQL} AS w FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(w) = 0 THEN []::VARCHAR[]
            WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh
        FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (
        SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
        FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (
        SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v
        WHERE 100 * c >= 85 * (a.n + b.n - c)),
    e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
    reach(doc_id, r) AS (
        SELECT doc_id, doc_id FROM documents
        UNION SELECT reach.doc_id, e.v FROM reach JOIN e ON reach.r = e.u)
    SELECT reach.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id,
           reach.doc_id = min(r) AS kept
    FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
    """,
)
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), NearDuplicates(shingle=3, percent=85, bands=30, rows=6))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query(
    "op10_mixing",
    r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 10))::BIGINT AS h
        FROM documents),
    s AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
        FROM d GROUP BY source),
    r AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
                      ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / (sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
        FROM s),
    t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM r),
    c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
    h AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
    u AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS before FROM h),
    x AS (
        SELECT u.source, h, (before + words <= target - copies * source_size)
               OR (before <= target - copies * source_size AND (target - copies * source_size - before) * 2 > words) AS extra
        FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source)
    SELECT d.doc_id, d.size, c.source_size, c.target, (d.size * (c.copies + x.extra::BIGINT))::BIGINT AS taken
    FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
    JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
    """,
)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = staged(sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "_hash"))
    return mix_sources(narrow).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), longest=4096, with_ids=False, special=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


_REACH_SQL = "list_position(list_transform(range(1, 51), lambda k: list_sum(n[i:i + k - 1]) >= 50), true)"


@query(
    "op9_line_dedup",
    f"""
    WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    flat AS (
        SELECT doc_id, unnest(range(0, len(ls))) AS idx, unnest(ls) AS line FROM raw),
    counted AS (
        SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM flat),
    docs AS (
        SELECT doc_id, list(line ORDER BY idx) AS l, list(n ORDER BY idx) AS n, list(idx ORDER BY idx) AS x
        FROM counted WHERE n > 0 GROUP BY doc_id),
    starts AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM docs),
    reach AS (SELECT *, {_REACH_SQL} AS k FROM starts),
    win AS (
        SELECT doc_id, i, x[i:i + k - 1] AS own, array_to_string(l[i:i + k - 1], chr(10)) AS key,
               x[i + k:i + k + t - 1] AS rest, l[i + k:i + k + t - 1] AS tail
        FROM (SELECT a.*, coalesce(b.k, len(a.l) - a.i - a.k + 1) AS t
              FROM reach a LEFT JOIN reach b ON b.doc_id = a.doc_id AND b.i = a.i + a.k WHERE a.k IS NOT NULL)),
    runs AS (
        SELECT doc_id, i, own, rest, j, md5(array_to_string(list_concat([key], tail[1:j]), chr(10))) AS run
        FROM (SELECT *, unnest(range(0, len(tail) + 1)) AS j FROM win)),
    firsts AS (SELECT run, min(doc_id * 1000000 + i) AS place FROM runs GROUP BY run),
    later AS (
        SELECT any_value(own) AS own, any_value(rest) AS rest, max(j) AS ext, doc_id
        FROM runs JOIN firsts USING (run) WHERE doc_id * 1000000 + i <> place GROUP BY doc_id, i),
    gone AS (
        SELECT DISTINCT doc_id, unnest(list_concat(own, rest[1:ext])) AS idx FROM later),
    kept AS (
        SELECT f.doc_id, string_agg(f.line, chr(10) ORDER BY f.idx) FILTER (WHERE g.idx IS NULL) AS text,
               count(*) AS n_lines, count(g.idx) AS n_removed
        FROM flat f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.idx = f.idx GROUP BY f.doc_id)
    SELECT raw.doc_id, CASE WHEN raw.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
           coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
    FROM raw LEFT JOIN kept USING (doc_id)
    """.replace("\\\\", "\\"),
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"), words=50, gram_words=20)
    return found.select("doc_id", "text", "n_lines", F.size("removed").cast("long").alias("n_removed"))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out_of_training = compression.held_out("doc_id", 3, 1)
    model = compression.fit(docs, labels.where(~out_of_training))
    scored = compression.score_quality(docs, model)
    return scored.select("doc_id", out_of_training.alias("held_out"), "score", "predicted")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = ordinal.fit(docs, labels.select("doc_id", labels["toxic"].alias("grade")))
    return ordinal.severity(docs.select("doc_id", "text"), model).select("doc_id", "severity", "p_toxic", "grade", "toxic")


@query(
    "op7_token_counts",
    r"""
    WITH firsts AS (
        SELECT source, lang, text FROM documents
        QUALIFY doc_id IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY coalesce(text, ''))),
    counts AS (
        SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM firsts
        UNION ALL
        SELECT source, lang, 'letters-2', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]')) FROM firsts)
    SELECT source, lang, version, count(*) AS docs, sum(tokens)::BIGINT AS tokens
    FROM counts GROUP BY source, lang, version
    """,
)
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in with provisional counts; exact later copies go; the rest is recounted
    exactly and counted by a second tokenizer version.  The first batch comes twice."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.md5(text).alias("digest"),
        F.ceil(F.length(text) / 6).cast("long").alias("provisional"),
        n_words(text).alias("words"),
        F.regexp_count(text, F.lit("[A-Za-z]+|[0-9]")).cast("long").alias("letters"),
    )
    docs = staged(docs)
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    docs = staged(docs.join(first, "digest").withColumn("later", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))))
    words, rest = docs.withColumn("version", F.lit("words-1")), docs.where("not later")
    load = insert(words.withColumn("tokens", F.col("provisional")))
    rollup = TokenRollup(spark, shared_folder(spark))
    rollup.commit("load", load)
    rollup.commit("copies", delete(words.where("later").withColumn("tokens", F.col("provisional"))))
    rollup.commit("load", load)
    recount = rest.select("source", "lang", F.lit("words-1").alias("version"), F.col("provisional").alias("old_tokens"), F.col("words").alias("tokens"))
    second = rest.select("source", "lang", F.lit("letters-2").alias("version"), F.col("letters").alias("tokens"))
    rollup.commit("recount", revise(recount).unionByName(insert(second)))
    rollup.compact()
    return rollup.totals()


_CRC_SQL = """
    bytes AS (SELECT range AS b FROM range(256)),
    crcs AS (
        SELECT list(c ORDER BY b) AS t FROM (
            SELECT b, list_reduce(list_concat([b], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM bytes)),
    ids AS (
        SELECT DISTINCT doc_id, 4294967295 - list_reduce(
            list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS crc
        FROM documents, crcs)"""


@query(
    "op3_lm_scoring",
    f"""
    WITH {_CRC_SQL},
    w AS (
        SELECT d.doc_id, coalesce(crc % 10 = 0, false) AS held_out, list_append(list_transform({_LOWER_WORDS_SQL}, lambda x: 'w' || x), '$') AS w
        FROM documents d LEFT JOIN ids ON ids.doc_id = d.doc_id),
    t AS (SELECT doc_id, held_out, unnest(w) AS b, unnest(list_prepend('^', w[1:len(w) - 1])) AS a FROM w),
    c1 AS (SELECT b, count(*) AS c FROM t WHERE NOT held_out GROUP BY b),
    c2 AS (SELECT a, b, count(*) AS c FROM t WHERE NOT held_out GROUP BY a, b),
    n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c1),
    p AS (
        SELECT t.*, coalesce(c1.c, 0) AS cb, coalesce(ca.c, CASE WHEN t.a = '^' THEN (SELECT count(*) FROM w WHERE NOT held_out) END, 0) AS ca,
               coalesce(c2.c, 0) AS cab, n.n, (coalesce(c1.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1)) AS root
        FROM t CROSS JOIN n LEFT JOIN c1 ON c1.b = t.b LEFT JOIN c1 ca ON ca.b = t.a LEFT JOIN c2 ON c2.a = t.a AND c2.b = t.b)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE cb > 0) AS n_known, max(n) AS train_tokens,
           round(sum(log10(root)), 6) AS base_score, round(sum(log10((cab + 2 * root) / (ca + 2))), 6) AS score
    FROM p GROUP BY doc_id, held_out
    """,
)
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


@query(
    "op2_topk",
    """
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(usable("embedding")).select("vec_id", whole_numbers("embedding").alias("v"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


_UPPER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op11_spelling",
    rf"""
    WITH RECURSIVE {_CRC_SQL.split("ids AS")[0].rstrip().rstrip(",")},
    runs AS (
        SELECT doc_id, translate(run, {_UPPER_SQL}) AS run FROM (
            SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
        WHERE length(run) >= 7),
    once AS (
        SELECT run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
    hashed AS (
        SELECT run, c, 4294967295 - list_reduce(
            list_concat([4294967295], list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) AS h
        FROM once, crcs),
    damaged AS (
        SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
    v AS (SELECT word, sum(c)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
    holes AS (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
    near AS (
        SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
        UNION SELECT h.word, h.n, v.word, v.n FROM holes h JOIN v ON v.word = h.a || h.b
        UNION SELECT v.word, v.n, h.word, h.n FROM holes h JOIN v ON v.word = h.a || h.b),
    best AS (
        SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
    forms AS (
        SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form,
               CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
        FROM v LEFT JOIN best ON best.word = v.word),
    walks(word, top) AS (
        SELECT word, word FROM forms
        UNION ALL SELECT walks.word, forms.form FROM walks JOIN forms ON forms.word = walks.top WHERE forms.form IS NOT NULL),
    roots AS (
        SELECT walks.word, walks.top AS root FROM walks JOIN forms ON forms.word = walks.top WHERE forms.form IS NULL)
    SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN roots ON roots.word = forms.word
    """,
)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run whose hash 31 divides loses a letter first."""
    runs = letter_runs(table(spark, sf_dir, "documents"), least=7)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    runs = runs.withColumn("_h", F.crc32(key.cast("binary"))).withColumn("_at", (F.col("_h") % F.char_length("run")).cast("int"))
    shorter = F.concat(F.left("run", F.col("_at")), F.expr("substr(run, _at + 2)"))
    words = runs.select(F.when(F.col("_h") % 31 == 0, shorter).otherwise(F.col("run")).alias("word"))
    found = spelling_variants(staged(count_words(words, shortest=7, rarest=2)), ratio=10)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query(
    "op12_substrings",
    rf"""
    WITH w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
    places AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM places),
    firsts AS (SELECT k, min(doc_id) AS d, arg_min(i, doc_id * 10000000 + i) AS i FROM win GROUP BY k),
    later AS (SELECT win.doc_id, win.i FROM win JOIN firsts USING (k) WHERE win.doc_id > d OR win.i > firsts.i),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
    flat AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w),
    kept AS (
        SELECT doc_id, count(*) AS n_words, count(gone.j) AS n_removed, string_agg(x, ' ' ORDER BY j) FILTER (WHERE gone.j IS NULL) AS kept
        FROM flat LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """,
)
def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), RepeatSettings(words=20), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn``: dropped, emptied, without ends of
    sentences, repeated, or said by the user.  Nulls count as one space."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    damaged = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)))
    return damaged.drop("col")


def _joined_digests(repaired: DataFrame) -> DataFrame:
    """(_key, repaired_sha256): of the rows ``role:text`` of each conversation, one per line.

    A digest has to read its rows in order; they stream through it.
    """

    def run(batches):
        at, digest = None, None
        for batch in batches:
            done = []
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("_key", "role", "text")), strict=True):
                if key != at:
                    if at is not None:
                        done.append({"_key": at, "repaired_sha256": digest.hexdigest()})
                    at, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(done, kinds)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"_key": at, "repaired_sha256": digest.hexdigest()}], kinds)

    kinds = pa.schema([("_key", pa.string()), ("repaired_sha256", pa.string())])
    keyed = repaired.withColumn("_key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    return keyed.repartition("_key").sortWithinPartitions("_key", "block", "place").select("_key", "role", "text").mapInArrow(
        run, "_key string, repaired_sha256 string"
    )


_FITS_SQL = {0: 2, 1: 2, 2: 3, 3: 2}
_TURN_SQL = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def _least_sql(state: int, step: str) -> str:
    """The least (cost, edits, rows) before a row, or with turns inserted first, in one state."""
    fits, turn = _FITS_SQL[state], _TURN_SQL[state]
    if step != "row":
        return f"least({{'c': {step}{fits}.c + 3, 'e': 'I' || {step}{fits}.e, 't': list_prepend('{turn}:', {step}{fits}.t)}}, b{state}) "
    keeps = f"CASE first WHEN 's' THEN {'a1' if state == 0 else 'NULL'} WHEN 'u' THEN {'NULL' if state == 2 else 'a2'} WHEN 'a' THEN {'a3' if state == 2 else 'NULL'} END"
    more = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    return f"""least(
        {{'c': a{state}.c + 4, 'e': 'D' || a{state}.e, 't': a{state}.t}},
        CASE WHEN fault IN ('', 'truncated') THEN {{'c': a{fits}.c + 3 + {more}, 'e': 'R' || a{fits}.e, 't': list_prepend('{turn}:' || text, a{fits}.t)}} END,
        CASE WHEN fault IN ('', 'truncated') AND ({keeps}) IS NOT NULL
             THEN {{'c': ({keeps}).c + {more}, 'e': 'K' || ({keeps}).e, 't': list_prepend(role || ':' || text, ({keeps}).t)}} END)"""


@query(
    "op13_conversations",
    rf"""
    WITH RECURSIVE {_CRC_SQL.split("ids AS")[0].rstrip().rstrip(",")},
    keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    kinds AS (
        SELECT DISTINCT k, (4294967295 - list_reduce(
            list_concat([4294967295], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
        FROM keyed, crcs),
    said AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
        FROM keyed JOIN kinds USING (k)),
    placed AS (
        SELECT conv_id, turn, role, text, substr(role, 1, 1) AS first,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
               right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
        FROM said),
    facts AS (
        SELECT *, lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first AS pair,
               CASE WHEN last = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
        FROM placed),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
               count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
               count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM facts GROUP BY conv_id),
    rest(conv_id, i, a0, a1, a2, a3) AS (
        SELECT conv_id, n::BIGINT, {{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}}, {{'c': 6::BIGINT, 'e': 'II', 't': ['user:', 'assistant:']}},
               {{'c': 3::BIGINT, 'e': 'I', 't': ['assistant:']}}, {{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}}
        FROM counts
        UNION ALL
        SELECT conv_id, i - 1, {", ".join(_least_sql(s, "o") for s in range(4))}
        FROM (SELECT *, {", ".join(f"{_least_sql(s, 'b')} AS o{s}" for s in range(4))}
              FROM (SELECT r.conv_id, r.i, {", ".join(f"{_least_sql(s, 'row')} AS b{s}" for s in range(4))}
                    FROM rest r JOIN facts f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i) x) y)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(a0.c, 0)::BIGINT AS cost,
           coalesce(a0.e, '') AS audit, sha256(coalesce(array_to_string(a0.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN rest r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.i = 0
    """,
)
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report, repaired = repair(damaged_conversations(rows))
    keyed = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("_key")
    every = rows.select("conv_id").distinct().select("conv_id", keyed)
    found = every.join(report.select(keyed, *[c for c in report.columns if c != "conv_id"]), "_key", "left").join(_joined_digests(repaired), "_key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
