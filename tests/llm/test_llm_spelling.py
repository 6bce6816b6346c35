import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm_cases import LOWER, ODD, rows
from pagetree.llm import queries, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(counts, ratio=10):
    """Brute force: every pair of words is compared."""
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def found(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    """Short words over few letters, so that most words have near ones, anagrams and long chains."""
    rnd = random.Random(seed)
    counts = {}
    while len(counts) < 350:
        word = "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6)))
        counts[word] = rnd.choice((1, 2, 3, 25, 30, 400, 9000))
    assert found(spelling.spelling_variants(frame(spark, counts))) == variants(counts)


def test_planted_edits_of_long_words(spark):
    """Each kind of edit at each place of a word, repeated letters included."""
    word = "bananarama" * 3
    counts = {word: 1000}
    for i in range(len(word) + 1):
        counts[word[:i] + "z" + word[i:]] = 3
        counts[word[:i] + word[i + 1 :]] = 2
        counts[word[:i] + "é" + word[i + 1 :]] = 1
    counts[word[::-1]] = 5
    assert found(spelling.spelling_variants(frame(spark, counts))) == variants(counts)


@pytest.mark.parametrize("parts", [(3, 2), (5, 4)])
def test_parts_change_nothing(spark, parts):
    rnd = random.Random(7)
    counts = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 5))): rnd.randint(1, 99) for _ in range(150)}
    got = spelling.spelling_variants(frame(spark, counts), parts_replaced=parts[0], parts_inserted=parts[1])
    assert found(got) == variants(counts)


def test_chains_end_at_their_root(spark):
    counts = {"aaaaaaaa": 1, "aaaaaaab": 10, "aaaaaabb": 100, "aaaaabbb": 1000, "aaaabbbb": 10_000, "aaabbbbb": 100_000}
    got = {r.word: r.root for r in spelling.spelling_variants(frame(spark, counts)).collect()}
    assert set(got.values()) == {"aaabbbbb"}


def test_ties_and_the_ratio(spark):
    counts = {"letters": 10, "lettersb": 100, "lettersa": 100, "letterz": 99}
    got = {r.word: (r.form, r.form_n) for r in spelling.spelling_variants(frame(spark, counts)).collect()}
    assert got["letters"] == ("lettersa", 100) and got["letterz"] == (None, None)


def test_hot_half(spark):
    """Many words share a half and most letters; no group may be lost."""
    counts = {f"prefixes{a}{b}": 1 for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"} | {"prefixesaaa": 50}
    assert found(spelling.spelling_variants(frame(spark, counts))) == variants(counts)


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 5), ("abcdefg", 2), ("abcdefgh", 40)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.spelling_variants(df).collect()}
    assert got == {None: (None, None, 0), "abcdefg": ("abcdefgh", "abcdefgh", 1), "abcdefgh": (None, "abcdefgh", 1)}
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_runs_of_odd_texts(make):
    docs = make(*ODD, (8, "ABCÀÿ×x-Y 9zZ"), (8, "a" * 30_000))
    runs = {(r.doc_id, r.run) for r in spelling.letter_runs(docs).collect()}
    assert {(8, "abcÀÿ×x"), (8, "y"), (8, "zz"), (8, "a" * 30_000), (7, "ünï"), (None, "text")} <= runs
    assert spelling.letter_runs(docs.limit(0)).count() == 0
    long = {r.run for r in spelling.letter_runs(docs, least=7).collect()}
    assert long == {run for _, run in runs if len(run) >= 7}
    counted = spelling.count_words(spelling.letter_runs(docs).withColumnRenamed("run", "word"), shortest=4, rarest=2)
    assert dict(rows(counted, "word", "n")) == {}


def test_query_on_a_fixture(spark, tmp_path):
    """The whole query, letters lost by hash included, against a plain version."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeÉ") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    vocabulary += [w[:-1] + "Q" for w in vocabulary[:20]]
    texts = [(i if i else None, " ".join(rnd.choices(vocabulary, k=120))) for i in range(60)] + [(99, None), (98, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = {}
    for doc, text in texts:
        for run in (text or "").translate(LOWER).split():
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert found(queries.op11_spelling(spark, str(tmp_path))) == variants(counts)


def test_signatures_are_bounded(spark):
    words = frame(spark, {"abcdefgh": 1})
    both = words.select("word", F.char_length("word").alias("_length"), F.split("word", "").alias("_letters"))
    both = both.select("word", "_length", spelling._parts(4).alias("_parts"))
    made = both.select(F.size(spelling._signatures(4, 2, "_length", spelling._halves("_length")))).first()[0]
    assert made == 12
