"""Colour and style expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import let
from .constants import CSS_RGB, INLINE_HEX, INLINE_RGB, STYLE_CHOICES, STYLE_COLORS, STYLE_NORMS, VISIBLE_ALPHA

COLOR = T.ArrayType(T.DoubleType())
STYLE_SCHEMA = T.StructType(
    [T.StructField(c, COLOR) for c in STYLE_COLORS]
    + [T.StructField(c, T.DoubleType()) for c in STYLE_NORMS]
    + [T.StructField(c, T.StringType()) for c in STYLE_CHOICES]
)


# ---------------------------------------------------------------- parsing CSS values


def parse_color(css: Column) -> Column:
    """``rgb()/rgba()`` to [r, g, b, a] in 0..1; null when there is no such colour."""
    inside = F.nullif(F.regexp_extract(css, CSS_RGB, 1), F.lit(""))

    def rgba(parts: Column) -> Column:
        number = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
        alpha = F.when(F.size(parts) > 3, F.get(number, F.lit(3))).otherwise(F.lit(1.0))
        scaled = F.transform(F.slice(number, 1, 3), lambda v: v / 255)
        return F.when(F.size(parts) >= 3, F.concat(scaled, F.array(alpha)))

    return let(F.split(inside, ","), rgba)


def parse_px(css: Column) -> Column:
    """First signed number of the text, else 0."""
    number = F.regexp_extract(css, r"(-?[0-9]+(?:\.[0-9]*)?|-?\.[0-9]+)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def style_default(value: Column, default, falsy_zero: bool = False) -> Column:
    """Default for a missing value; with ``falsy_zero`` also for 0, NaN and empty text."""
    if isinstance(default, str):
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
    value = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    if falsy_zero:
        value = F.nullif(value, F.lit(0.0))
    return F.coalesce(value, F.lit(float(default)))


def hex_number(code: Column) -> Column:
    """``#RGB`` or ``#RRGGBB`` as one number; null when there is no such colour.

    No lambda: runs in generated code.  ``code`` is read several times, so it should be a column.
    """
    digits = F.ltrim(code, F.lit("#"))
    doubled = F.concat(*[F.substring(digits, i, 1) for i in (1, 1, 2, 2, 3, 3)])
    # of five digits the last is a channel of its own
    last = F.concat(F.left(digits, F.lit(4)), F.lit("0"), F.substring(digits, 5, 1))
    six = (
        F.when(digits.rlike("^[0-9a-fA-F]{6}"), F.left(digits, F.lit(6)))
        .when(digits.rlike("^[0-9a-fA-F]{5}"), last)
        .when(digits.rlike(r"^[0-9a-fA-F]{3}\z"), doubled)
    )
    return F.conv(six, 16, 10).cast("long")


def number_to_rgba(number: Column) -> Column:
    """A colour's number to [r, g, b, 1.0]."""
    channels = [F.shiftright(number, bits).bitwiseAND(F.lit(255)) / F.lit(255.0) for bits in (16, 8, 0)]
    return F.when(number.isNotNull(), F.array(*channels, F.lit(1.0)))


def hex_to_rgba(code: Column) -> Column:
    """``#RGB`` or ``#RRGGBB`` to [r, g, b, 1.0]."""
    return let(let(code, hex_number), number_to_rgba)


def _inline_hex(node_text: Column) -> Column:
    # only texts with the sign that such a colour has are searched for it
    code = F.nullif(F.regexp_extract(node_text, INLINE_HEX, 1), F.lit(""))
    return F.when(F.contains(node_text, F.lit("#")), code)


def _inline_rgb(node_text: Column) -> Column:
    parts = [F.regexp_extract(node_text, INLINE_RGB, i) for i in (1, 2, 3)]
    rgba = F.array(*[p.try_cast("double") / 255 for p in parts], F.lit(1.0))
    return F.when(F.contains(node_text, F.lit("rgb(")) & (parts[0] != ""), rgba)


def inline_color(node_text: Column) -> Column:
    """First inline hex colour of a node, else its first inline rgb colour, else null."""
    return F.coalesce(hex_to_rgba(_inline_hex(node_text)), _inline_rgb(node_text))


_RGBA = "struct<r: double, g: double, b: double, a: double>"


def _channels(color: Column) -> Column:
    return F.struct(*[F.get(color, F.lit(i)).alias(n) for i, n in enumerate("rgba")])


def rgba_struct(color: Column) -> Column:
    return let(color, _channels)


def no_paints() -> Column:
    return F.array().cast(f"array<struct<type: string, color: {_RGBA}>>")


def paints(color: Column, shown: Callable[[Column], Column]) -> Column:
    """A SOLID paint where the colour is to be shown, else an empty list."""
    return let(color, lambda c: _listed(c, F.coalesce(shown(c), F.lit(False))))


def _listed(color: Column, shown: Column) -> Column:
    solid = F.array(F.struct(F.lit("SOLID").alias("type"), _channels(color).alias("color")))
    return F.when(shown, solid).otherwise(no_paints())


def inline_fill(node_text: Column) -> Column:
    """Fill list of the first inline colour; empty when there is none."""
    return paints(inline_color(node_text), lambda c: c.isNotNull())


def with_inline_color(nodes: DataFrame, out: str = "color") -> DataFrame:
    """Nodes with the ``inline_color`` of their ``node_text``, one step a projection: no lambda runs."""
    steps = {
        "_code": _inline_hex(F.col("node_text")),
        "_number": hex_number(F.col("_code")),
        out: F.coalesce(number_to_rgba(F.col("_number")), _inline_rgb(F.col("node_text"))),
    }
    for name, value in steps.items():
        nodes = nodes.withColumn(name, value)
    return nodes.drop("_code", "_number")


def with_inline_fill(nodes: DataFrame, out: str = "fills") -> DataFrame:
    """Nodes with the ``inline_fill`` of their ``node_text``, likewise."""
    colored = with_inline_color(nodes, "_color")
    return colored.withColumn(out, _listed(F.col("_color"), F.col("_color").isNotNull())).drop("_color")


def fills_strokes(background: Column, border: Column) -> tuple[Column, Column]:
    """Background and border paints, shown above an alpha of 0.05."""
    def shown(c: Column) -> Column:
        return F.get(c, F.lit(3)) > VISIBLE_ALPHA

    return paints(background, shown), paints(border, shown)


# ---------------------------------------------------------------- encoding


def normalize_color(color: Column) -> Column:
    """Four channels; zeros when the colour is null or short."""
    return F.when(F.size(color) >= 4, F.slice(color, 1, 4).cast("array<double>")).otherwise(
        F.array(*[F.lit(0.0)] * 4)
    )


def color_valid(color: Column) -> Column:
    return F.when(F.get(normalize_color(color), F.lit(3)) > 0, 1.0).otherwise(0.0)


def encode_number(value: Column, norm: Column) -> Column:
    """Value over its norm, clamped to [0, 1]; 0 when missing."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double") / norm))
    return F.when(value.isNull(), 0.0).otherwise(scaled)


def encode_choice(value: Column, choices: tuple[str, ...]) -> Column:
    """Index in the list of choices; 0 for missing or unknown values."""
    listed = F.array(*[F.lit(c) for c in choices])
    return F.greatest(F.coalesce(F.array_position(listed, value), F.lit(1)) - 1, F.lit(0)).cast("int")


def encode_styles_struct(style: Column) -> Column:
    """Encoded form of one style struct: reg, reg_valid, color, color_valid, cls_*."""
    numbers = F.array(*[style.getField(k).cast("double") for k in STYLE_NORMS])
    norms = F.array(*[F.lit(n) for n in STYLE_NORMS.values()])
    colors = F.array(*[style.getField(k).cast(COLOR) for k in STYLE_COLORS])
    return F.struct(
        F.zip_with(numbers, norms, encode_number).alias("reg"),
        F.transform(numbers, lambda v: F.when(v.isNull(), 0.0).otherwise(1.0)).alias("reg_valid"),
        F.transform(colors, normalize_color).alias("color"),
        F.transform(colors, color_valid).alias("color_valid"),
        *[encode_choice(style.getField(k), ch).alias(f"cls_{k}") for k, ch in STYLE_CHOICES.items()],
    )


# ---------------------------------------------------------------- decoding


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    if high is not None:
        value = F.least(F.lit(high), value)
    return value if low is None else F.greatest(F.lit(low), value)


def clamp_rules(opacity: Column, fill_opacity: Column, corner_radius: Column, visible: Column) -> Column:
    return F.struct(
        clamp(opacity, 0.0, 1.0).alias("opacity"),
        clamp(fill_opacity, 0.0, 1.0).alias("fill_opacity"),
        clamp(corner_radius, 0.0).alias("corner_radius"),
        (visible > 0.5).alias("visible"),
    )


def denormalize_style(reg: Column) -> Column:
    """Predicted numbers (0..1) back to CSS units, each kept in its legal range."""
    v = {k: F.get(reg, F.lit(i)) * n for i, (k, n) in enumerate(STYLE_NORMS.items())}
    return F.struct(
        clamp(v["borderRadius"], 0.0).alias("cornerRadius"),
        clamp(v["borderWidth"], 0.0).alias("strokeWeight"),
        clamp(v["opacity"], 0.0, 1.0).alias("opacity"),
        clamp(v["fontSize"], 0.0).alias("fontSize"),
        clamp(v["fontWeight"], 100.0, 900.0).alias("fontWeight"),
    )


def argmax(scores: Column) -> Column:
    """Position of the largest score, the lowest one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_style_class(scores: Column, choices: tuple[str, ...]) -> Column:
    listed = F.array(*[F.lit(c) for c in choices])
    return F.get(listed, F.least(argmax(scores), F.lit(len(choices) - 1)))
