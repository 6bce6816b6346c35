import math
import zlib
from collections import Counter

import pytest
from llm_cases import LOWER, ODD, prose, rows, words

from pagetree.llm.backoff import BackoffSettings, score_texts

COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def brute(docs, how):
    out = [(d, d is not None and zlib.crc32(str(d).encode()) % how.modulus == 0) for d, *_ in docs]
    texts = [words((r[1] or "").translate(LOWER)) + ["</s>"] for r in docs]
    single, pair, context = Counter(), Counter(), Counter()
    for (_, held), text in zip(out, texts, strict=True):
        if not held:
            single.update(text)
            pair.update(zip(["<s>", *text], text))
            context.update(["<s>", *text[:-1]])
    total, distinct = sum(single.values()), len(single)
    root = lambda w: (single[w] + how.base) / (total + how.base * (distinct + 1))
    found = []
    for (d, held), text in zip(out, texts, strict=True):
        steps = [(pair[a, b] + how.pseudo * root(b)) / (context[a] + how.pseudo) for a, b in zip(["<s>", *text], text)]
        found.append((d, held, len(text), sum(single[w] > 0 for w in text), total, sum(math.log10(root(w)) for w in text), sum(map(math.log10, steps))))
    return sorted(found, key=lambda r: [(v is None, v) for v in r])


@pytest.mark.parametrize("how", [BackoffSettings(), BackoffSettings(modulus=3, block_bytes=2000, piece_entries=500, pseudo=0.5)])
def test_matches_brute_force(make, how):
    docs = [*ODD, *[(i, prose(40, i % 4) + " The end. the END") for i in range(20, 60)]]
    found = rows(score_texts(make(*docs), how), *COLUMNS)
    expected = brute(docs, how)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_empty_table(make):
    assert score_texts(make()).count() == 0


def test_probabilities_add_up(make):
    """Every known word, the end and one unknown word after a context: their arcs sum to one."""
    held = [i for i in range(1, 5000) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    train = [i for i in range(1, 50) if zlib.crc32(str(i).encode()) % 10][:3]
    docs = make(*zip(train, ("a b a", "b c", "a b"), strict=True), *zip(held, ("a a", "a b", "a c", "a unknown", "a"), strict=True))
    score = {r[0]: r[1] for r in rows(score_texts(docs), "doc_id", "score")}
    by = brute([*zip(train, ("a b a", "b c", "a b"), strict=True), *zip(held, ("a a", "a b", "a c", "a unknown", "a"), strict=True)], BackoffSettings())
    assert score == pytest.approx({r[0]: r[6] for r in by})
    single = {"a": 3, "b": 3, "c": 1, "</s>": 3}
    root = {w: (c + 0.1) / (10 + 0.1 * 5) for w, c in single.items()} | {"?": 0.1 / 10.5}
    after_a = {"b": 2, "</s>": 1}
    assert sum(root.values()) == pytest.approx(1)
    assert sum((after_a.get(w, 0) + 2 * p) / (3 + 2) for w, p in root.items()) == pytest.approx(1)
