import hashlib
import random

import numpy as np
import pytest

from llm_cases import ODD, prose, rows, words
from pagetree.llm.substrings import RepeatSettings, remove_repeats, repeat_profile, windows
from pagetree.llm.words import word_hashes

LAST = (1 << 63) - 1


def brute(docs, size):
    """(doc_id, n_words, n_removed, digest) per row, by comparing windows as lists of words."""
    least, split = {}, [(LAST if d is None else d, words(t)) for d, t in docs]
    for doc, found in split:
        for i in range(len(found) - size + 1):
            key = tuple(found[i : i + size])
            least[key] = min(least.get(key, LAST), doc)
    out = []
    for (doc_id, _), (doc, found) in zip(docs, split):
        seen, gone = set(), set()
        for i in range(len(found) - size + 1):
            key = tuple(found[i : i + size])
            if key in seen or least[key] < doc:
                gone.update(range(i, i + size))
            seen.add(key)
        kept = [w for i, w in enumerate(found) if i not in gone]
        out.append((doc_id, len(found), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: [(v is None, v) for v in r])


def got(df):
    return rows(df, "doc_id", "n_words", "n_removed", "kept_sha256")


def shuffled_passages(seed, n=120):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(rnd.randint(3, 60))) for _ in range(25)]
    docs = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else prose(rnd.randint(1, 30), rnd.randint(0, 9999)) for _ in range(rnd.randint(0, 6))]
        docs.append((rnd.choice((i, i // 2, None)), rnd.choice((" ", "\n", " \t")).join(parts)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("how", [
    RepeatSettings(), RepeatSettings(block_bytes=300, piece_entries=50), RepeatSettings(words=8, least=2), RepeatSettings(words=7),
    RepeatSettings(words=40, block_bytes=2000),
])
def test_brute_force(make, seed, how):
    docs = shuffled_passages(seed)
    assert got(remove_repeats(make(*docs).repartition(3), how)) == brute(docs, how.words)


def test_planted_passage_inside_other_texts(make):
    passage = prose(55, 1)
    docs = [(i, f"{prose(30 + i, 100 + i)} {passage} {prose(10, 200 + i)}") for i in range(5)] + [(9, prose(80, 7))]
    found = {r.doc_id: (r.n_removed, [tuple(s) for s in r.removed]) for r in remove_repeats(make(*docs)).collect()}
    assert found[0] == (0, []) and found[9] == (0, [])
    assert all(found[i] == (55, [(30 + i, 55)]) for i in range(1, 5))


def test_repeats_inside_a_text_and_ties(make):
    run = prose(20, 3)
    docs = [(1, f"{run} x {run}"), (2, prose(19, 4)), (2, prose(19, 4)), (3, " ".join(["a"] * 60)), (4, " ".join(["a"] * 20)), (4, prose(25, 5)), (4, prose(25, 5))]
    found = remove_repeats(make(*docs))
    assert got(found) == brute(docs, 20)
    assert sorted((r.doc_id, r.n_removed) for r in found.collect()) == [(1, 20), (2, 0), (2, 0), (3, 59), (4, 0), (4, 0), (4, 20)]


def test_odd_rows_and_columns(make):
    docs = make(*ODD, (8, prose(12_000)), (9, prose(12_000) + " end"))
    found = remove_repeats(docs)
    assert found.columns == [*[c for c in docs.columns if c != "removed"], "n_words", "n_removed", "removed", "kept_sha256"]
    by_id = {r.doc_id: r for r in found.collect() if r.doc_id is not None}
    assert by_id[1].text is None and by_id[2].text == "" and by_id[8].text == "" and by_id[9].text == "end"
    assert by_id[5].text == prose(12_000) and by_id[6].n_removed == 60 and by_id[7].text == "ünï çödé 字 \x1c a"
    assert by_id[9].component == "y" and by_id[9]["a.b"] == 1
    assert got(found) == brute([(r[0], r[1]) for r in ODD] + [(8, prose(12_000)), (9, prose(12_000) + " end")], 20)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_without_text(make):
    docs = shuffled_passages(3, 30)
    narrow = remove_repeats(make(*docs).select("doc_id", "text"), with_text=False)
    assert narrow.columns == ["doc_id", "n_words", "n_removed", "removed", "kept_sha256"] and got(narrow) == brute(docs, 20)


def test_levels():
    assert RepeatSettings().lengths == [5, 10, 20]
    assert RepeatSettings(words=50).lengths == [25, 50]
    with pytest.raises(ValueError):
        RepeatSettings(words=131).lengths  # noqa: B018
    hashes = word_hashes(prose(50) + " " + prose(50))
    assert np.array_equal(windows(hashes, 5, 20)[:31], windows(hashes, 5, 20)[50:])
    assert len(windows(hashes[:19], 5, 20)) == 0 and len(windows(hashes[:20], 5, 20)) == 1


def test_profile_doubles_until_nothing_repeats(make):
    docs = [(1, prose(100, 1)), (2, prose(45, 2) + " " + prose(100, 1)), (3, prose(30, 4)), (4, None)]
    seen = {}
    for _, text in docs:
        found = words(text)
        for size in (5, 10, 20, 40, 80, 160):
            for i in range(len(found) - size + 1):
                seen.setdefault(size, {}).setdefault(tuple(found[i : i + size]), []).append(i)
    want = [(size, n) for size in sorted(seen) if (n := sum(len(v) > 1 for v in seen[size].values()))]
    assert rows(repeat_profile(make(*docs), RepeatSettings(block_bytes=500)), "length", "n_windows") == want == [(5, 96), (10, 91), (20, 81), (40, 61), (80, 21)]
    assert repeat_profile(make((1, prose(99)), (2, None))).count() == 0
