"""Removing repeated runs of lines, found by winnowing over line hashes.

Lines with a word are hashed.  From every line on, the fewest lines that hold ``words`` words make a
window, and the fewest that hold ``gram_words`` make a gram.  Each window selects the least of the
gram hashes inside it.  Two texts that share a run of ``words`` words share a window, hence the
gram it selects: windows whose selected gram occurs nowhere else are dropped before anything is
compared.  The others meet their first occurrence by the hash of the whole window.  A match reaches
backwards by itself, as the window that starts a line earlier matches too; forwards it is extended
line by line: against the first place by comparison and, where places continue in different ways,
against every other by the hash of each extension.  The matched lines of the later place go.

Everything is column expressions inside a document, and joins against one row per hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import staged

_LAST = (1 << 63) - 1


def _reach(start: str, words: str, lines: str = "_lines") -> str:
    """SQL: (number of lines, words) of the fewest lines from ``start`` with so many words."""
    return (
        f"aggregate(slice({lines}, {start}, {words}), struct(0 AS n, 0 AS w), "
        f"(a, x) -> if(a.w >= {words}, a, struct(a.n + 1 AS n, a.w + x.w AS w)))"
    )


def _doc_key() -> list[Column]:
    """``_doc`` orders documents, null ids last; with ``_text`` it tells rows of one id apart."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_doc"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text"),
    ]


def windows(docs: DataFrame, words: int, gram_words: int) -> DataFrame:
    """(_doc, _text, at, key, gram, gram_at, own, rest, tail) for each window of each document.

    ``at`` counts lines with a word; ``own`` has the line numbers of the window, ``rest`` those of
    the lines behind it up to ``words`` words more, and ``tail`` the hashes of these.
    """
    lines = (
        "filter(transform(split(coalesce(text, ''), '\\n'), (x, i) -> struct(i AS i, xxhash64(x) AS h, "
        "regexp_count(x, '[^\\\\x20\\\\x09-\\\\x0D]+') AS w)), x -> x.w > 0)"
    )
    hashed = "xxhash64(transform(slice(_lines, i + 1, r.n), y -> y.h))"
    grams = (
        f"transform(_lines, (x, i) -> transform(array({_reach('i + 1', gram_words)}), r -> "
        f"struct(r.n AS n, if(r.w >= {gram_words}, {hashed}, NULL) AS h))[0])"
    )
    found = f"""transform(_reach, (r, i) -> if(r.w < {words}, NULL, struct(
        i AS at,
        struct({hashed} AS a, xxhash64(transform(slice(_lines, i + 1, r.n), y -> y.h), 1) AS b) AS key,
        array_min(filter(
            transform(slice(_grams, i + 1, r.n), (g, k) -> if(k + g.n <= r.n, struct(g.h AS h, -(i + k) AS p), NULL)),
            g -> g.h IS NOT NULL)) AS gram,
        transform(slice(_lines, i + 1, r.n), y -> y.i) AS own,
        if(i + r.n < size(_lines), slice(_lines, i + r.n + 1, get(_reach, i + r.n).n), slice(_lines, 1, 0)) AS rest)))"""
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return (
        texts.select(*_doc_key(), F.expr(lines).alias("_lines"))
        .select("*", F.expr(f"transform(_lines, (x, i) -> {_reach('i + 1', words)})").alias("_reach"), F.expr(grams).alias("_grams"))
        .select("_doc", "_text", F.explode(F.expr(found)).alias("w"))
        .where("w is not null")
        .select(
            "_doc", "_text", "w.at", "w.key", F.col("w.gram.h").alias("gram"), (-F.col("w.gram.p")).alias("gram_at"), "w.own",
            F.expr("transform(w.rest, y -> y.i)").alias("rest"), F.expr("transform(w.rest, y -> y.h)").alias("tail"),
        )
    )


def _longest(shared: DataFrame) -> DataFrame:
    """(_doc, _text, at, _more): how many lines behind a window an earlier place of it has as well.

    Only windows with three places or more and unlike tails are looked at: for others the first
    place says it all.
    """
    digest = F.xxhash64("tail")
    unlike = shared.groupBy("key").agg(F.count("*").alias("_n"), F.min(digest).alias("_x"), F.max(digest).alias("_y")).where("_n > 2 and _x <> _y")
    part = "slice(tail, 1, k)"
    parts = f"transform(sequence(1, size(tail)), k -> struct(k AS _more, xxhash64({part}) AS _a, xxhash64({part}, 1) AS _b))"
    place = F.struct("_doc", "_text", "at")
    longer = shared.where("size(tail) > 0").join(unlike.select("key"), "key", "left_semi")
    longer = longer.select("_doc", "_text", "at", "key", F.expr(f"inline({parts})"))
    hashes = ["key", "_more", "_a", "_b"]
    firsts = longer.groupBy(*hashes).agg(F.min(place).alias("_from"), F.max(place).alias("_to")).where("_from <> _to").drop("_to")
    found = longer.join(firsts, hashes).where(place != F.col("_from"))
    return found.groupBy("_doc", "_text", "at").agg(F.max("_more").alias("_more"))


def repeated_lines(docs: DataFrame, words: int = 50, gram_words: int = 20) -> DataFrame:
    """(_doc, _text, removed): per document with any, the numbers of its lines to remove, in order."""
    every = staged(windows(docs, words, gram_words))
    place = F.struct("_doc", "_text", "gram_at")
    grams = every.groupBy("gram").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a <> _b").select("gram")
    shared = staged(every.join(grams, "gram", "left_semi").drop("gram", "gram_at"))
    firsts = (
        shared.groupBy("key")
        .agg(F.min(F.struct("_doc", "_text", "at", "tail")).alias("_first"), F.max(F.struct("_doc", "_text", "at")).alias("_last"))
        .where("struct(_first._doc, _first._text, _first.at) <> _last")
        .select("key", "_first")
    )
    later = shared.join(firsts, "key").where("struct(_doc, _text, at) <> struct(_first._doc, _first._text, _first.at)")
    # the tails agree up to their first difference
    differ = F.array_position(F.expr("zip_with(tail, _first.tail, (x, y) -> x <=> y)"), False)
    more = F.when(differ == 0, F.size("rest")).otherwise(F.greatest(differ - 1, F.lit(0)).cast("int"))
    later = later.join(_longest(shared), ["_doc", "_text", "at"], "left")
    extended = F.slice("rest", F.lit(1), F.greatest(more, F.coalesce("_more", F.lit(0))))
    return (
        later.select("_doc", "_text", F.explode(F.concat("own", extended)).alias("line"))
        .groupBy("_doc", "_text")
        .agg(F.sort_array(F.collect_set("line")).alias("removed"))
    )


def dedup_lines(docs: DataFrame, words: int = 50, gram_words: int = 20) -> DataFrame:
    """``docs`` with the later places of repeated runs taken out of ``text``; plus ``removed``, the
    line numbers (from 0), and ``n_lines``.

    A run is ``words`` words or more in consecutive lines that have a word; blank lines between
    them are passed over and stay.  It goes if any earlier place has it.  The first place in the
    order of doc_id (null last) and line keeps its lines, also inside one document.  Rows equal in
    id and text count as one document and all keep their lines.  Null texts stay null; a text can
    become empty; an empty table gives an empty result.  Columns named removed or n_lines are
    replaced.
    """
    if not 1 <= gram_words <= words:
        raise ValueError("gram_words must be between 1 and words")
    found = repeated_lines(docs, words, gram_words)
    columns = [c for c in docs.columns if c not in ("removed", "n_lines")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), *_doc_key())
    joined = rows.join(found, ["_doc", "_text"], "left").withColumn("_all", F.split(F.col("_row.text").cast("string"), "\n"))
    kept = F.expr("transform(array_except(sequence(0, size(_all) - 1), removed), i -> get(_all, i))")
    text = F.when(F.col("removed").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[(text if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in columns],
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_lines"),
    )
