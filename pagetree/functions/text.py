"""Text, tag and name expressions for pages and serialised nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    DEFAULT_TYPE,
    MIN_PAGE_CHARS,
    NAME_ATTRIBUTE,
    NAME_FIRST_WORD,
    NAME_TAG,
    NODE_TYPES,
    SKIP_TAGS,
    TAG_TYPES,
)


def pick_html(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty (text, html, content)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def long_enough(html: Column, n: int = MIN_PAGE_CHARS) -> Column:
    return F.coalesce(F.length(html) >= n, F.lit(False))


def is_drawn(tag: Column, skip: tuple[str, ...] = SKIP_TAGS) -> Column:
    return ~F.lower(tag).isin(*skip)


def escape_attr(value: Column) -> Column:
    return F.replace(value, F.lit('"'), F.lit("&quot;"))


def attr_list(attrs: Column) -> Column:
    """`` name="value"`` per attribute, in source order; attrs is array<struct<name,value>>."""
    return F.array_join(
        F.transform(
            attrs,
            lambda a: F.concat(
                F.lit(" "), a["name"], F.lit('="'), escape_attr(F.coalesce(a["value"], F.lit(""))), F.lit('"')
            ),
        ),
        "",
    )


def direct_text(text: Column, limit: int | None = None) -> Column:
    """Trimmed (all leading and trailing white space) and, with a ``limit``, cut to so many code points."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return trimmed if limit is None else F.substring(trimmed, 1, limit)


def serialize_node(tag: Column, attrs: Column, text: Column) -> Column:
    """``<tag a="v">text</tag>``."""
    return F.concat(
        F.lit("<"), tag, attr_list(attrs), F.lit(">"), F.coalesce(text, F.lit("")), F.lit("</"), tag, F.lit(">")
    )


def node_tag(node_text: Column, mode: str = "strict") -> Column:
    """Tag name of a serialised node.

    ``strict`` reads the tag name; ``reference`` takes the text up to the first blank and strips
    angle brackets from its ends, so ``<a></a>`` reads as ``a></a``.
    """
    if mode == "reference":
        return F.btrim(F.substring_index(node_text, " ", 1), F.lit("<>"))
    return F.regexp_extract(node_text, r"^<([A-Za-z][\w-]*)", 1)


def _tag_map() -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(t) for t in TAG_TYPES]), F.array(*[F.lit(t) for t in TAG_TYPES.values()])
    )


def node_type(tag: Column) -> Column:
    """Design type of a tag.  The 34 tags are a literal, so no join is needed."""
    return F.coalesce(F.try_element_at(_tag_map(), F.lower(tag)), F.lit(DEFAULT_TYPE))


def node_type_index(type_name: Column) -> Column:
    names = F.array(*[F.lit(t) for t in NODE_TYPES])
    return F.greatest(F.array_position(names, type_name) - 1, F.lit(0)).cast("int")


def node_type_name(index: Column) -> Column:
    names = F.array(*[F.lit(t) for t in NODE_TYPES])
    return F.coalesce(F.get(names, index), F.lit(DEFAULT_TYPE))


def _attribute(node_text: Column, name: str, mode: str) -> Column:
    # reference mode accepts a match after any word boundary (so data-id= counts as id=)
    lead = r"\b" if mode == "reference" else r"\s"
    found = F.regexp_extract(node_text, lead + name + NAME_ATTRIBUTE, 1)
    # most texts lack most attributes: a plain search finds that sooner than the pattern
    return F.when(~F.contains(node_text, F.lit(f"{name}=")), "").otherwise(found)


def node_name(node_text: Column, type_name: Column, mode: str = "strict") -> Column:
    """``tag#id``, else ``tag.firstClass``, else ``tag[aria-label]``, else tag, else the type."""
    tag = F.regexp_extract(node_text, NAME_TAG, 1)
    ident = _attribute(node_text, "id", mode)
    first_class = F.regexp_extract(_attribute(node_text, "class", mode), NAME_FIRST_WORD, 1)
    label = _attribute(node_text, "aria-label", mode)
    return (
        F.when(tag == "", type_name)
        .when(ident != "", F.concat(tag, F.lit("#"), ident))
        .when(first_class != "", F.concat(tag, F.lit("."), first_class))
        .when(label != "", F.concat(tag, F.lit("["), label, F.lit("]")))
        .otherwise(tag)
    )


# Start tags of well-formed or sloppy HTML: name, then attributes up to the closing bracket.
START_TAG = r"<([A-Za-z][A-Za-z0-9-]*)(?:[ \t\r\n/][^>]*)?>"


def start_tags(html: Column) -> Column:
    """All start-tag names in page order, lower-cased."""
    return F.transform(F.regexp_extract_all(html, F.lit(START_TAG), 1), F.lower)
