"""Texts shared by the tests of this folder."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(n, seed=0):
    """``n`` different words in a fixed order."""
    return " ".join(f"w{seed}x{i}" for i in range(n))


#: Nulls, blanks, a long text, a repeated row and odd characters: (doc_id, text, lang, source).
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "text without an id"), (None, None, None, None),
    (4, "short"), (5, prose(12_000), None, "src1"), (6, prose(60), "de", None), (6, prose(60), "de", None),
    (7, "ünï çödé 字 \x1c a", "fr", "src2"),
]


def words(text):
    return WORD.findall(text or "")


def shingles(text, size):
    found = words((text or "").translate(LOWER))
    if not found:
        return set()
    size = min(size, len(found))
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def rows(df, *columns):
    """Rows as tuples, nulls last."""
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: [(v is None, v) for v in r])
