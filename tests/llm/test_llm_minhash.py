import random

import numpy as np
import pytest
from llm_cases import ODD, prose, rows, shingles

from pagetree.llm import words as w
from pagetree.llm.graph import components
from pagetree.llm.minhash import NearDuplicates, near_duplicates, signature


def brute(docs, how):
    """Smallest reachable id per document, by comparing every pair."""
    sets = {i: shingles(t, how.shingle) for i, t in docs}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= how.percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def edited(text, places, seed):
    found = text.split()
    for k in random.Random(seed).sample(range(len(found)), places):
        found[k] = f"edit{seed}y{k}"
    return " ".join(found)


@pytest.mark.parametrize("how", [NearDuplicates(shingle=3, percent=85, bands=30, rows=6), NearDuplicates(block=4, block_shingles=600)])
def test_matches_brute_force(make, how):
    docs = [(i, prose(120, i % 3)) for i in range(10, 16)]
    docs += [(100 + i, edited(prose(120, 1), 1 + i % 8, i)) for i in range(24)]
    docs += [(200 + i, edited(prose(150, 7), 5, i)) for i in range(20)]
    docs += [(300, prose(2)), (301, prose(2)), (302, "W0x0 w0X1"), (303, prose(1))]
    docs += docs[10:40:2]  # repeated rows
    found = {i: (n, c) for i, n, c in rows(near_duplicates(make(*docs), how), "doc_id", "n_shingles", "component_id")}
    assert found == brute(docs, how)


def test_odd_rows(make):
    found = rows(near_duplicates(make(*ODD)), "doc_id", "n_shingles", "component_id", "kept")
    assert [r for r in found if r[0] is None] == [(None, 0, None, True), (None, 1, None, True)]
    assert [r for r in found if r[0] == 6] == [(6, 56, 6, True)] * 2
    assert {r[0] for r in found if r[1] == 0 and r[3]} == {1, 2, 3, None}
    assert len(found) == len(ODD)
    assert near_duplicates(make()).count() == 0


def test_hashes_follow_chunks():
    text = prose(30_000) + " " + "long" * 50_000 + " end"
    data = text.encode()
    direct = [w.word_hashes(x)[0] for x in ("w0x0", "w0x29999", "long" * 50_000, "end")]
    found = w.word_hashes(data)
    assert len(found) == 30_002
    assert direct == [found[0], found[29_999], found[30_000], found[30_001]]
    assert (w.word_hashes("Ab ÄB") == w.word_hashes("aB Äb")).all()
    assert len(np.unique(found)) == 30_002


def test_signature_estimates_similarity():
    a = w.shingle_set(w.word_hashes(prose(400)), 5)
    b = w.shingle_set(w.word_hashes(edited(prose(400), 10, 3)), 5)
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a, 2000) == signature(b, 2000)).mean() - exact) < 0.05


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (5, 4)]
    found = dict(rows(components(spark.createDataFrame(chain, "u long, v long")), "node", "component"))
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
