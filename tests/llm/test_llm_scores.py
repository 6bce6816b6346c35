import math

import numpy as np
import pytest
from llm_cases import ODD, rows

from pagetree.llm import compression, ordinal

SETTINGS = compression.CompressionSettings(dictionary=4096)


def area(labels, scores):
    """Chance that a row of class 1 scores above one of class 0."""
    wins = [(a > b) + 0.5 * (a == b) for a, x in zip(scores, labels, strict=True) if x == 1 for b, y in zip(scores, labels, strict=True) if y == 0]
    return sum(wins) / len(wins)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice(["river", "stone", "bridge", "meadow", "harbour", "winter"], 40))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "CLICK!!", "FREE!!", "|||"], 40))
    return [(i, good() if i % 3 else bad()) for i in range(240)]


def test_quality_held_out_accuracy(spark, make, texts):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in texts if i < 160] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = compression.fit(make(*texts, *ODD), labels, SETTINGS)
    found = {r[0]: r for r in rows(compression.score_quality(make(*[t for t in texts if t[0] >= 160]), model, SETTINGS), "doc_id", "score", "predicted")}
    assert area([int(i % 3 > 0) for i in found], [r[1] for r in found.values()]) >= 0.99
    assert all(0 <= r[1] <= 1 and r[2] == int(r[1] >= 0.5) for r in found.values())


def test_quality_odd_rows(spark, make, texts):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in texts], "doc_id long, quality int")
    model = compression.fit(make(*texts), labels, SETTINGS)
    found = rows(compression.score_quality(make(*ODD), model, SETTINGS), "doc_id", "score")
    assert len(found) == len(ODD) and all(0 <= s <= 1 for _, s in found)
    by = {}
    for doc, s in found:
        by.setdefault(doc, set()).add(s)
    assert by[1] == by[2] and len(by[6]) == 1  # null as empty; repeated rows alike
    assert compression.score_quality(make(), model, SETTINGS).count() == 0
    assert compression.fit(make(*texts), labels.where("quality = 1"), SETTINGS) is None
    assert compression.fit(make(), labels, SETTINGS) is None
    assert {r[1] for r in rows(compression.score_quality(make(*ODD), None), "doc_id", "score")} == {0.5}


def test_long_texts_score_like_short_ones(texts):
    good, bad = (("\n".join(t for i, t in texts if bool(i % 3) == side)).encode()[:4096] for side in (True, False))
    short = compression.difference(texts[1][1], good, bad, SETTINGS)
    long = compression.difference(" ".join(t for i, t in texts if i % 3) * 20, good, bad, SETTINGS)
    assert short > 0.05 and long > 0.02


def test_crc_split(spark):
    ids = spark.createDataFrame([(1,), (44,), (None,)], "doc_id long")
    import zlib

    found = dict(rows(ids.select("doc_id", compression.held_out("doc_id", 3, 1).alias("h")), "doc_id", "h"))
    assert found == {1: zlib.crc32(b"1") % 3 == 1, 44: zlib.crc32(b"44") % 3 == 1, None: False}


def test_toxicity_grades(spark, make):
    rng = np.random.default_rng(5)
    insults = ["idiot", "scum", "moron"]
    docs, labels = [], []
    for i in range(400):
        body = rng.choice([f"word{k}" for k in range(300)], 60).tolist()
        level = i % 8 if i % 8 <= 3 else 0
        for k in range(level):
            body.insert(int(rng.integers(0, 60)), insults[k].upper() + ",")
        docs.append((i, " ".join(body)))
        labels.append((i, int(level > 0), level))
    docs, graded = make(*docs), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, toxic int, level int")
    for grade in ("level", "toxic"):  # grades as given, and grades made from yes and no
        model = ordinal.fit(docs, graded.where("doc_id < 300").selectExpr("doc_id", f"{grade} AS grade"))
        assert (np.diff(model.thresholds) >= 0).all()
        strongest = model.words[np.argsort(-model.weights)[:3]]
        assert set(strongest) == {ordinal.features(x)[0] for x in insults}
        found = {r[0]: r for r in rows(ordinal.severity(docs, model), "doc_id", "severity", "p_toxic", "grade", "toxic")}
        held = [(i, level) for i, _, level in labels if i >= 300]
        assert np.mean([found[i][4] == (level > 0) for i, level in held]) >= 0.95
        assert area([int(level > 0) for _, level in held], [found[i][1] for i, _ in held]) >= 0.99
        mean = [np.mean([found[i][1] for i, x in held if x == level]) for level in range(4)]
        assert mean == sorted(mean)
        assert all(0 <= r[1] <= len(model.thresholds) and not math.isnan(r[1]) for r in found.values())


def test_toxicity_odd_rows(spark, make):
    docs = make(*ODD, (40, "idiot"), (41, "fine"))
    model = ordinal.OrdinalModel(np.sort(ordinal.features("idiot")), np.array([9.0]), np.array([4.0, 5.0]))
    found = ordinal.severity(docs, model)
    assert found.columns == [*docs.columns, "severity", "p_toxic", "grade", "toxic"]
    assert [r[0] for r in rows(found.where("toxic"), "doc_id")] == [40]
    assert found.count() == len(ODD) + 2 and ordinal.severity(make(), model).count() == 0
    assert ordinal.fit(docs, spark.createDataFrame([(1, 0), (40, 0)], "doc_id long, grade int")) is None
    assert ordinal.fit(make(), spark.createDataFrame([], "doc_id long, grade int")) is None
    assert ordinal.severity(docs, None).where("toxic or severity <> 0").count() == 0
