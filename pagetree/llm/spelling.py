"""Spelling variants: words that differ by one letter, found with PartEnum signatures.

A word's letters are a multiset, that is a binary vector with one place for each letter and number
of the occurrence.  A replaced letter changes two places of it, an inserted or deleted one changes
one.  The places are dealt into ``parts`` parts by their hash.  Two vectors that differ in k places
agree on all parts but k, so the enumeration of all ways to leave out k parts yields signatures of
which such vectors share one: k = 2 among words of one length, k = 1 between a word and words that
are a letter longer.  Words that share a signature are joined on it and verified.

Words of a language use few letters, so many share a signature.  An edit lies in one half of a word
and leaves the other as it is; each signature is therefore stated once with each half (that of the
shorter word), which splits its group.  No pair within the limit is lost by that, and the join stays
an equi-join on a hash with two words per row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import staged
from .words import lowered

#: Letters: A to Z, a to z and the Latin-1 range from U+00C0 to U+00FF.
LETTERS = "A-Za-z\\u00C0-\\u00FF"


def letter_runs(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, run): each maximal run of ``least`` letters or more, A-Z lower-cased; no run in a
    null text."""
    found = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", lowered(F.col("run")).alias("run"))


def count_words(words: DataFrame, shortest: int = 7, rarest: int = 2) -> DataFrame:
    """(word, n): the words with ``shortest`` code points or more that occur ``rarest`` times or more."""
    long_enough = words.where(F.char_length("word") >= shortest)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


def _parts(parts: int) -> Column:
    """One hash per part: of the (letter, occurrence) places dealt to it.  Order plays no role."""
    place = f"xxhash64(c, size(filter(slice(_letters, 1, i), y -> y = c)))"
    places = f"transform(_letters, (c, i) -> {place})"
    mine = "filter(_places, h -> pmod(shiftrightunsigned(h, 17), {n}) = p)".format(n=parts)
    return F.expr(
        f"transform(array({places}), _places -> transform(sequence(0, {parts - 1}), "
        f"p -> aggregate({mine}, 0L, (a, h) -> a ^ h)))[0]"
    )


def _signatures(parts: int, left_out: int, length: str, half: tuple[str, str]) -> Column:
    """Array of hashes: every way to leave out so many parts, with each half of a word."""
    listed = []
    for number, gone in enumerate(combinations(range(parts), left_out)):
        kept = " ^ ".join(f"_parts[{p}]" for p in range(parts) if p not in gone)
        listed += [f"xxhash64({left_out}, {number}, {side}, {length}, {text}, {kept})" for side, text in enumerate(half)]
    return F.expr(f"array({', '.join(listed)})")


def _halves(length: str) -> tuple[str, str]:
    """First and last part of ``word`` as a word of ``length`` letters is halved."""
    return f"left(word, {length} div 2)", f"right(word, {length} - {length} div 2)"


def near_words(words: DataFrame, parts_replaced: int = 4, parts_inserted: int = 3) -> DataFrame:
    """(word, n, other, other_n): pairs of words at an edit distance of exactly one, both ways.

    ``words`` has one row per word (word, n); null words take no part.  More parts mean more
    signatures and fewer candidates; the result is the same.
    """
    known = words.where("word is not null").select("word", "n", F.char_length("word").alias("_length"), F.split("word", "").alias("_letters"))
    both = {}
    for parts in {parts_replaced, parts_inserted}:
        both[parts] = known.select("word", "n", "_length", _parts(parts).alias("_parts"))

    def signed(parts: int, left_out: int, shorter: int) -> DataFrame:
        length = f"(_length - {shorter})"
        signatures = _signatures(parts, left_out, length, _halves(length))
        return both[parts].select("word", "n", F.explode(signatures).alias("_signature"))

    def met(a: DataFrame, b: DataFrame, order: Column | None = None) -> DataFrame:
        two = b.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "_signature")
        pairs = a.join(two, "_signature")
        close = F.levenshtein("word", "other", 1) == 1
        return pairs.where(close if order is None else order & close).select("word", "n", "other", "other_n")

    same = signed(parts_replaced, 2, 0)
    found = met(same, same, F.col("word") < F.col("other")).union(
        met(signed(parts_inserted, 1, 0), signed(parts_inserted, 1, 1))
    )
    pairs = staged(found.distinct())
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms ends.  A form is more frequent than its word, so
    chains end; each round doubles the stretch that a word has followed."""
    links = forms.where("form is not null").select("word", F.col("form").alias("root"))
    links = staged(links)
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = staged(links.join(further, "root", "left"))
        if moved.where("_next is not null").isEmpty():
            return links
        links = staged(moved.select("word", F.coalesce("_next", "root").alias("root")))


def spelling_variants(words: DataFrame, ratio: int = 10, **parts) -> DataFrame:
    """Per row of ``words`` (word, n): word, n, n_near, form, form_n, root.

    ``form`` is the near word with the largest n, the first in code-point order among equals, if
    its n is at least ``ratio`` times that of the word; ``root`` is the word at the end of the chain
    of forms, the word itself without one.  ``words`` must have a word once; a null word has
    nothing near it.  Ties are settled as stated; an empty table gives an empty result; other
    columns are ignored.
    """
    known = words.select("word", "n")
    best = near_words(known, **parts).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w"))).alias("_best")
    )
    common = -F.col("_best.n") >= ratio * F.col("n")
    found = staged(
        known.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, F.col("_best.w")).alias("form"), F.when(common, -F.col("_best.n")).cast("long").alias("form_n"),
        )
    )
    return found.join(_roots(found), "word", "left").withColumn("root", F.coalesce("root", "word"))
