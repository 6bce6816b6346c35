"""Each stage of the pipeline on its own input, against a plain version of what it decides."""

import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from llm_cases import ODD, prose, rows, shingles, words

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from pagetree.llm import queries  # noqa: E402

STAGE = dict(pipeline.STAGES)
INSULTS = ("idiot", "scum", "moron")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: plain documents, toxic ones, copies and shared passages."""
    rng = np.random.default_rng(11)
    body = lambda n: " ".join(rng.choice([f"word{k}" for k in range(500)], n))
    passage = body(80)
    docs = [(i, body(70), "en", f"src{i % 3}") for i in range(150)]
    docs += [(200 + i, " ".join([body(40), *rng.permutation(INSULTS), body(30)]), "en", "src0") for i in range(60)]
    docs += [(300 + i, f"{body(30)}\n{passage}\n{body(30)}", "en", "src1") for i in range(5)]
    docs += [(400 + i, docs[3][1] + " changed", "en", "src2") for i in range(4)]
    docs += [(500, None, None, None), (501, "", "de", None), (None, "no id", "en", "src0"), (502, docs[4][1], "en", "src1"), (502, docs[4][1], "en", "src1")]
    path = tmp_path_factory.mktemp("corpus")
    table = [(d, t, lang, s, len(t or "")) for d, t, lang, s in docs]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(d, 1, int(200 <= d < 260)) for d, *_ in docs if d is not None and d < 260 and d % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = docs.collect()

    clean = STAGE["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    left = Counter(r.doc_id for r in clean.collect())
    assert left == Counter(r.doc_id for r in given if r.doc_id is None or not 200 <= r.doc_id < 260)

    lines = STAGE["line_dedup"](spark, clean, folder)
    assert lines.columns == docs.columns
    seen, expected = set(), Counter()
    for r in sorted(clean.collect(), key=lambda r: (r.doc_id is None, r.doc_id)):
        kept = []  # every line here of 50 words or more is a run of its own
        for line in (r.text or "").split("\n"):
            if len(words(line)) < 50 or (line not in seen) or r.doc_id == 502 and (502, line) in seen:
                kept.append(line)
                if line not in seen and r.doc_id == 502:
                    seen.add((502, line))
            if len(words(line)) >= 50:
                seen.add(line)
        text = None if r.text is None else "\n".join(kept)
        if words(r.text) and not words(text):
            continue  # all of its words were copies
        expected[r.doc_id, text, len(text) if text is not None else None] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in lines.collect()) == expected

    # as chained: what had words has some, and one of each group of near duplicates is left
    assert {r.doc_id for r in lines.collect() if not words(r.text)} == {r.doc_id for r in clean.collect() if not words(r.text)}
    chained = STAGE["near_dedup"](spark, lines, folder)
    left_sets = {r.doc_id: shingles(r.text, 5) for r in chained.collect() if r.doc_id is not None and words(r.text)}
    found = list(left_sets.values())
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(found) for b in found[:i])
    mixed = STAGE["mixing"](spark, chained, folder)
    assert {r.doc_id for r in mixed.collect() if not words(r.text)} <= {r.doc_id for r in given if not words(r.text)}

    # judged on its own input: here the documents before their lines went
    single = STAGE["near_dedup"](spark, clean, folder)
    assert single.columns == docs.columns
    sets = [(r.doc_id, shingles(r.text, 5)) for r in clean.collect() if r.doc_id is not None]
    kept = {d for d, s in sets if not s or not any(e < d and o and 100 * len(s & o) >= 80 * len(s | o) for e, o in sets)}
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(kept)
    assert [r.text for r in single.where("doc_id is null").collect()] == ["no id"]

    mixed = STAGE["mixing"](spark, single, folder)
    assert mixed.columns == docs.columns
    sizes, taken = Counter(), Counter()
    for r in single.collect():
        sizes[r.source] += len(words(r.text))
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
    target = {"src0": 1, "src1": 2, "src2": 3}
    for source, weight in target.items():
        share = min(3 * sizes[source], sum(sizes.values()) * weight / 6)
        assert abs(taken[source] - share) <= 160
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3

    packed = STAGE["packing"](spark, mixed, folder)
    assert packed.agg({"length": "sum"}).first()[0] == sum(r.doc_tokens for r in packed.where("start = 0").collect())
    assert packed.where("start = 0").count() == mixed.count()


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
    columns = ("doc_id", "start", "length", "ids_crc32")
    assert rows(pipeline.run(spark, folder), *columns) == rows(docs, *columns)


def test_stages_take_odd_tables(spark, make, folder):
    docs = make(*ODD)
    for name, stage in pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            found = stage(spark, given, folder)
            assert name == "packing" or found.columns == docs.columns
            assert (found.count() > 0) == (given is docs)


def test_registered():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
