"""Rollups, quality rules, line dedup and mixing."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import ODD, prose, rows, words

from pagetree.llm.mixing import mix_sources, sized
from pagetree.llm.outliers import OutlierRules, quality_rules, statistics
from pagetree.llm.rollups import TokenRollup, delete, insert, revise
from pagetree.llm.winnow import dedup_lines

TOTALS = ("source", "lang", "version", "docs", "tokens")


def test_rollup_batches_commit_once(spark, tmp_path):
    table = lambda *r: spark.createDataFrame(list(r), "source string, lang string, version string, tokens long, old_tokens long, docs string")
    kept = TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert kept.totals().count() == 0
    first = table(("a", "en", "v1", 10, None, ""), ("a", "en", "v1", 5, None, ""), (None, None, "v1", None, None, ""), ("b", "en", "v1", 7, None, ""))
    assert kept.commit("one/α", insert(first)) and not kept.commit("one/α", insert(first))
    assert kept.commit("two", delete(table(("b", "en", "v1", 7, None, ""), ("a", "en", "v1", 5, None, ""))).union(revise(table(("a", "en", "v1", 12, 10, "")))))
    expected = [("a", "en", "v1", 1, 12), (None, None, "v1", 1, 0)]
    assert rows(kept.totals(), *TOTALS) == expected
    kept.compact()
    assert rows(kept.totals(), *TOTALS) == expected and kept.batches() == ["one/α", "two"]
    assert not TokenRollup(spark, f"file://{tmp_path}/rollup").commit("two", insert(first))
    assert kept.commit("empty", insert(first.limit(0))) and kept.commit("three", insert(first))
    kept.compact()
    assert rows(kept.totals(), *TOTALS) == [("a", "en", "v1", 3, 27), ("b", "en", "v1", 1, 7), (None, None, "v1", 2, 0)]


def test_rollup_writes_a_broken_batch_anew(spark, tmp_path):
    kept = TokenRollup(spark, str(tmp_path))
    rows_ = spark.createDataFrame([("a", "en", "v1", 3)], "source string, lang string, version string, tokens long")
    insert(rows_).selectExpr("*", "cast(null AS string) AS batch").write.parquet(f"{tmp_path}/batch=x")
    (tmp_path / "batch=x" / "_SUCCESS").unlink()
    assert kept.totals().count() == 0 and kept.commit("x", insert(rows_))
    assert rows(kept.totals(), *TOTALS) == [("a", "en", "v1", 1, 3)]


def counts(text):
    found, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = {i + k for i in range(len(found) - 4) if seen[tuple(found[i : i + 5])] > 1 for k in range(5)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(make):
    docs = [*ODD, (20, "a b c d e f a b c d e x\n#1 | <b>\n\n#1 | <b>\n \n"), (21, "z " * 40), (22, prose(30) + " " + prose(30) + " q " + prose(9)), (23, "1 2 3 4 5"), (24, "1 2 3 4 5 1 2 3 4 5")]
    found = rows(statistics(make(*docs)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert found == sorted([(d[0], *counts(d[1])) for d in docs], key=lambda r: [(v is None, v) for v in r])


def test_outliers_by_group(make):
    rng = np.random.default_rng(6)
    body = lambda n: " ".join(rng.choice([f"wo{'r' * (k % 5)}d{k}" for k in range(2000)], n))
    docs = [(i, body(int(rng.integers(80, 200))), "en", "src0") for i in range(150)]
    docs += [(200 + i, body(100).replace(" ", " | "), "en", "src0") for i in range(20)]
    docs += [(300 + i, " | ".join(words(body(100))), "en", "tables") for i in range(60)]  # usual in this source
    docs += [(400 + i, "| " * 30, None, None) for i in range(3)]  # too few to judge, but all repeats
    found = rows(quality_rules(make(*docs)), "doc_id", "outlier", "kept", "base_failed")
    judged = {r[0]: r for r in found}
    assert all(judged[200 + i][1] for i in range(20))
    assert sum(judged[i][2] for i in range(150)) >= 148 and sum(judged[300 + i][2] for i in range(60)) >= 58
    assert all(judged[400 + i] == (400 + i, False, False, True) for i in range(3))
    assert found == rows(quality_rules(make(*docs)), "doc_id", "outlier", "kept", "base_failed")


def test_outliers_of_small_groups_are_judged_by_a_pool(make):
    rng = np.random.default_rng(12)
    body = lambda n: " ".join(rng.choice([f"wo{'r' * (k % 5)}d{k}" for k in range(2000)], n))
    piped = lambda: " | ".join(words(body(60)))
    docs = [(i, body(int(rng.integers(80, 200))), "en", f"site{i}") for i in range(120)]  # one document per source
    docs += [(200 + i, piped(), "en", f"pipes{i}") for i in range(3)]
    docs += [(300 + i, body(int(rng.integers(80, 200))), "en", "few") for i in range(12)] + [(320, piped(), "en", "few")]
    docs += [(400, body(120), "fy", "rare"), (401, piped(), "fy", "rarer")]  # no language of this size: all documents
    found = rows(quality_rules(make(*docs)), "doc_id", "outlier", "base_failed", "distance")
    assert all(r[3] is not None for r in found)
    assert {r[0] for r in found if r[0] in (200, 201, 202, 320, 401) and r[1] and not r[2]} == {200, 201, 202, 320, 401}
    assert sum(r[1] for r in found) <= 5 + 3


def test_outliers_match_numpy(make):
    """The final distances, from the concentration steps done in numpy."""
    from pagetree.llm import outliers as o

    rng = np.random.default_rng(7)
    docs = [(i, " ".join("x" * int(rng.integers(2, 9)) + str(k) for k in range(int(rng.integers(20, 90)))) + " #" * int(rng.integers(0, 4))) for i in range(80)]
    how = OutlierRules(steps=3)
    table = statistics(make(*docs))
    got = {r[0]: r[1] for r in rows(o.robust_outliers(table.drop("text"), how), "doc_id", "distance")}
    vectors = {r.doc_id: [r[f"_x{k}"] for k in range(5)] for r in table.withColumns(o._vector()).collect()}
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    centre = np.array([sorted(np.floor(x[:, k] / 64))[(len(ids) - 1) // 2] * 64 + 32 for k in range(5)])
    cov = np.eye(5)
    for step in range(how.steps + 1):
        d = np.einsum("ij,jk,ik->i", (x - centre) / 1024, np.linalg.inv(cov), (x - centre) / 1024)
        if step < how.steps:
            bins = np.floor(np.log2(d + 1e-9) * 16)
            near = x[bins <= np.sort(bins)[int(np.ceil(len(ids) * how.share)) - 1]]
            centre = near.mean(axis=0)
            cov = np.cov(near.T, bias=True) / 1024**2 * o._consistency(how.share) + np.diag(np.array(how.floors) ** 2)
    assert [got[i] for i in ids] == pytest.approx(d.tolist(), rel=1e-6)


def test_quality_rules_odd_rows(make):
    found = rows(quality_rules(make(*ODD)), "doc_id", "n_words", "base_failed", "kept")
    assert len(found) == len(ODD)
    assert [r[0] for r in found if r[3]] == [5, 6, 6]
    assert quality_rules(make()).count() == 0


def repeated(docs, least):
    """Line numbers to remove per document, by the definition: all runs that an earlier place has."""
    seen, gone = set(), {}
    for d, text in sorted(docs):
        lines = [(i, x, len(words(x))) for i, x in enumerate((text or "").split("\n")) if words(x)]
        for i in range(len(lines)):
            for end in range(i + 1, len(lines) + 1):
                if sum(w for *_, w in lines[i:end]) >= least:
                    key = tuple(x for _, x, _ in lines[i:end])
                    if key in seen:
                        gone.setdefault(d, set()).update(j for j, *_ in lines[i:end])
                    seen.add(key)
    return {d: sorted(v) for d, v in gone.items()}


def test_line_dedup_matches_brute_force(make):
    rng = np.random.default_rng(8)
    pool = [prose(int(rng.integers(1, 30)), 100 + k) for k in range(40)] + [" ", "", prose(70, 999)]
    runs = [[pool[k] for k in rng.integers(0, 43, 6)] for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [pool[k] for k in rng.integers(0, 43, 5)] + runs[int(rng.integers(0, 6))] + [f"own line {i}"] + runs[int(rng.integers(0, 6))][: int(rng.integers(1, 7))]
        docs.append((i, "\n".join(parts)))
    found = dedup_lines(make(*docs), words=30, gram_words=10).collect()
    expected = repeated(docs, 30)
    texts = dict(docs)
    assert {r["doc_id"]: list(r["removed"]) for r in found if r["removed"]} == expected
    for r in found:
        lines = texts[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for i, x in enumerate(lines) if i not in expected.get(r["doc_id"], []))
        assert r["n_lines"] == len(lines)


def test_line_dedup_extends_against_every_earlier_place(spark, make):
    import corpus_pipeline

    x, y = prose(60, 1), prose(30, 2)
    few = [(1, x), (2, f"{x}\n{y}"), (3, f"{x}\n{y}\nend"), (4, f"{x}\n{y}\nend")]
    assert repeated(few, 50) == {2: [0], 3: [0, 1], 4: [0, 1, 2]}
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, make(*few), "").collect()}
    assert kept == {1: x, 2: y, 3: "end"}  # nothing of the last one is its own
    rng = np.random.default_rng(13)
    pool = [prose(int(rng.integers(1, 30)), 100 + k) for k in range(12)] + [" ", prose(70, 999)]
    docs = [(i, "\n".join(pool[k] for k in rng.integers(0, 14, 14))) for i in range(60)]
    found = dedup_lines(make(*docs), words=30, gram_words=10).collect()
    assert {r["doc_id"]: list(r["removed"]) for r in found if r["removed"]} == repeated(docs, 30)


def test_line_dedup_odd_rows(make):
    long = "\n".join(f"{prose(5, k)}" for k in range(3000))
    docs = make(*ODD, (60, prose(60) + "\n"), (61, "x\n" + prose(60)), (62, long), (63, "top\n\n" + long), (None, prose(60)))
    found = dedup_lines(docs)
    assert found.columns == [*[c for c in docs.columns if c != "removed"], "removed", "n_lines"]
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append((r["text"], list(r["removed"])))
    assert got[6] == [(prose(60), [])] * 2  # rows equal in id and text count as one document
    assert got[60] == [("", [0])] and got[61] == [("x", [1])] and got[62] == [(long, [])]
    assert got[63][0][0] == "top\n" and len(got[63][0][1]) == 3000
    assert got[1] == [(None, [])] and got[2] == [("", [])] and ("", [0]) in got[None]
    assert dedup_lines(make()).count() == 0
    with pytest.raises(ValueError):
        dedup_lines(docs, words=5, gram_words=6)


def shared_out(sizes, weights=(1, 2, 3)):
    """Targets by resharing the excess until none is above three times its source."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while open_ and rest > 1e-9:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 3 * sizes[s]}
        if not full:
            for s in open_:
                target[s] = share * weight[s]
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


def test_mixing_targets_and_thresholds(make):
    rng = np.random.default_rng(9)
    names = ["b", "a", "Z", "é", None, "tiny", "huge", "10", "9", ""]
    docs = [(i, prose(int(rng.integers(1, 40)), i), "en", str(n) if n is not None else None) for n in names for i in range(1000 * names.index(n), 1000 * names.index(n) + {"tiny": 2, "huge": 300}.get(n, 40))]
    found = mix_sources(sized(make(*docs))).collect()
    sizes = Counter()
    for _, text, _, source in docs:
        sizes[source] += len(words(text))
    target = shared_out(sizes)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for source in sizes:
        mine = [r for r in found if r["source"] == source]
        assert {r["source_size"] for r in mine} == {sizes[source]}
        assert mine[0]["target"] == pytest.approx(target[source])
        assert abs(sum(r["taken"] for r in mine) - target[source]) <= 40
        # nested: a document that is taken once more has a lower hash than one that is not
        most, least = max(r["copies"] for r in mine), min(r["copies"] for r in mine)
        digest = lambda r: hashlib.md5(f"{r['doc_id']}\n{r['text']}".encode()).hexdigest()[:10]
        if most > least:
            assert most == least + 1 and max(digest(r) for r in mine if r["copies"] == most) < min(digest(r) for r in mine if r["copies"] == least)
        assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in mine)


def test_mixing_odd_rows(make):
    docs = make(*ODD, (70, None, None, "void"))
    found = mix_sources(sized(docs))
    assert found.count() == len(ODD) + 1
    assert {(r["target"], r["taken"]) for r in found.where("source = 'void'").collect()} == {(0.0, 0)}
    assert len({r["copies"] for r in found.where("doc_id = 6").collect()}) == 1
    assert rows(found, "doc_id", "copies", "taken") == rows(mix_sources(sized(docs)), "doc_id", "copies", "taken")
    assert mix_sources(sized(make())).count() == 0
