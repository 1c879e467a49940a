"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once rather than for each entry of a lambda that names it."""
    return F.transform(F.array(value), use)[0]


def softmax(xs: Column) -> Column:
    """Shifted by the largest entry."""
    shifted = _bound(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(x - top)))

    def shares(each: Column) -> Column:
        total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        return _bound(total, lambda t: F.transform(each, lambda x: x / t))

    return _bound(shifted, shares)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def avoid_inf(x: Column) -> Column:
    """NaN as 0, beyond 1e300 clamped."""
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.least(x, F.lit(1e300)), F.lit(-1e300)))


def round_int(x: Column) -> Column:
    """``x + 0.5`` truncated."""
    v = x + 0.5
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("int")


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(F.when(x > 0, x))).otherwise(F.lit(float("-inf")))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def pow2_round_up(x: Column) -> Column:
    """The least power of two not below ``x``."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(x.cast("double"), F.lit(1.0))))).cast("long")


def nearly_equal(a: Column, b: Column, eps: float = 1e-15) -> Column:
    return F.abs(a - b) <= eps


def bitset(values: Column) -> Column:
    """32-bit words, as longs, with a bit set for each value of an array."""
    words = F.sequence(F.lit(0), F.floor(F.array_max(values) / 32).cast("int"))
    inside = lambda w: F.array_distinct(F.filter(values, lambda v: F.floor(v / 32) == w))
    return F.transform(words, lambda w: F.aggregate(inside(w), F.lit(0).cast("long"), lambda a, v: a + F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(32)).cast("int"))))


def in_bitset(words: Column, value: Column) -> Column:
    word = F.try_element_at(words, F.floor(value / 32).cast("int") + 1)
    return F.coalesce(F.call_function("shiftright", word, F.pmod(value, F.lit(32)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def arg_max(xs: Column) -> Column:
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def arg_min(xs: Column) -> Column:
    return (F.array_position(xs, F.array_min(xs)) - 1).cast("int")


def kth_largest(xs: Column, k: int) -> Column:
    return F.try_element_at(F.sort_array(xs, False), F.lit(k))


def max_k(xs: Column, k: int) -> Column:
    return F.slice(F.sort_array(xs, False), 1, k)


def partition_three(xs: Column, pivot: Column) -> Column:
    """Larger, equal and smaller entries, each in order."""
    return F.struct(F.filter(xs, lambda x: x > pivot).alias("above"), F.filter(xs, lambda x: x == pivot).alias("equal"), F.filter(xs, lambda x: x < pivot).alias("below"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vector_sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vector_mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def vector_scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * k)


def vector_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def all_equal(xs: Column) -> Column:
    return F.forall(xs, lambda x: x == xs[0])


def all_zero(xs: Column) -> Column:
    return F.forall(xs, lambda x: x == 0)


def co_sort(keys: Column, values: Column) -> Column:
    """Values in the order of their keys."""
    return F.transform(F.array_sort(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))), lambda p: p["v"])


def split_any(text: Column, delimiters: str) -> Column:
    """Parts between any of the delimiters, without empty ones."""
    inside = "".join("\\" + d for d in delimiters)
    return F.filter(F.split(text, f"[{inside}]"), lambda p: p != "")


def split_brackets(text: Column, left: str = "(", right: str = ")") -> Column:
    return F.regexp_extract_all(text, F.lit(f"\\{left}([^\\{right}]*)\\{right}"), F.lit(1))


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"']|[\"']$", "")


def parse_int(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def parse_float(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def parse_list(text: Column, delimiter: str = ",") -> Column:
    return F.transform(F.split(text, delimiter), lambda x: F.trim(x).try_cast("double"))


def join_range(xs: Column, start: int, length: int, delimiter: str = ",") -> Column:
    return F.array_join(F.slice(xs, start + 1, length), delimiter)


def config_value(text: Column, key: str) -> Column:
    """The value of ``key = value`` in a text of such lines, comments off; null if absent."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^[ \t]*{key}[ \t]*=([^#\n]*)", 1)), F.lit(""))


def strip_json_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)/\*.*?\*/|(?m)//[^\n]*$", "")


def json_field(text: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(text), f"$.{path}", kind)


def json_has_shape(text: Column, fields: dict[str, str]) -> Column:
    """Whether every named field is there with its kind (as ``schema_of_variant`` names it)."""
    fits = F.lit(True)
    for name, kind in fields.items():
        part = F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant")
        fits = fits & F.coalesce(F.schema_of_variant(part) == kind, F.lit(False))
    return fits
