"""Scalar column expressions; all of them stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def optional(df: DataFrame, name: str, default=None) -> Column:
    """The column if df has it, else a literal."""
    return F.col(name) if has_column(df, name) else F.lit(default)


def patient_of(barcode: Column | str) -> Column:
    """Characters 1 to 12 of a sample barcode."""
    return F.substring(_col(barcode), 1, 12)


def sample_type_of(barcode: Column | str) -> Column:
    """The two-character sample type code at position 14."""
    return F.substring(_col(barcode), 14, 2)


def sample_group(barcode: Column | str, tumour=("01",), normal=("11",)) -> Column:
    code = sample_type_of(barcode)
    return F.when(code.isin(*tumour), "tumour").when(code.isin(*normal), "normal").otherwise("other")


def strip_version(gene_id: Column | str) -> Column:
    """The identifier before its first dot."""
    return F.regexp_replace(_col(gene_id), r"\..*$", "")


def first_available(df: DataFrame, names: list[str], fallback: Column) -> Column:
    """The first of several alternative columns that df has, else the fallback."""
    return next((F.col(n) for n in names if has_column(df, n)), fallback)


def split_fields(packed: Column | str, sep: str = ";") -> Column:
    """NULL gives [NULL], '' an empty array; one trailing empty field is dropped."""
    c = _col(packed)
    parts = F.split(c, f"[{sep}]")
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(c.isNull(), F.array(F.lit(None).cast("string"))).when(c == "", F.array().cast("array<string>")).otherwise(trimmed)


def distinct_fields(packed: Column | str, sep: str = ";") -> Column:
    """Number of distinct non-empty fields; 0 for NULL."""
    c = F.coalesce(_col(packed), F.lit(""))
    return F.size(F.array_distinct(F.filter(F.split(c, f"[{sep}]"), lambda x: x != "")))


def string_bool(c: Column | str) -> Column:
    return F.coalesce(_col(c).isin("True", "TRUE", "1"), F.lit(False))


def edge_sign(stimulation: Column | str, inhibition: Column | str, unsigned: int = 0) -> Column:
    """+1 for stimulation alone, -1 for inhibition alone, else the value for unsigned edges."""
    s, i = string_bool(stimulation), string_bool(inhibition)
    return F.when(s & ~i, 1).when(i & ~s, -1).otherwise(unsigned)


def m_value(beta: Column | str, eps: float = 1e-3) -> Column:
    """log2 odds of a share, clamped to [eps, 1 - eps]; NULL stays NULL."""
    b = _col(beta)
    b = F.when(b.isNotNull(), F.least(F.greatest(b, F.lit(eps)), F.lit(1 - eps)))
    return F.log2(b / (1 - b))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def rounded_half(c: Column | str, digits: int) -> Column:
    """Rounded half away from zero after a product with 10**digits in doubles, as SQL engines round them; F.round takes the shortest decimal text instead."""
    scale = float(10**digits)
    return F.round(_col(c) * scale) / scale


def sign(c: Column | str) -> Column:
    """-1, 0 or 1 as a double, never -0."""
    return F.signum(_col(c)) + F.lit(0.0)


def is_finite(c: Column | str) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))


def concordance(expr_score, expr_direction, prom_score, prom_direction, body_score, body_direction, promoter_weight: float = 1.0, body_weight: float = 0.5) -> Column:
    """Bonus for agreement: expression against promoter, and with gene body; NULL counts as 0."""
    z = lambda c: F.coalesce(_col(c), F.lit(0.0))
    promoter = F.when(z(prom_direction) * z(expr_direction) < 0, F.sqrt(z(prom_score) * z(expr_score))).otherwise(0.0)
    body = F.when(z(body_direction) * z(expr_direction) > 0, F.sqrt(z(body_score) * z(expr_score))).otherwise(0.0)
    return promoter * promoter_weight + body * body_weight


def change_class(delta: Column | str, fdr: Column | str, cutoff: float = 0.05, least: float = 0.0) -> Column:
    """hyper, hypo or unchanged."""
    d, f = _col(delta), _col(fdr)
    found = F.coalesce((f < cutoff) & (F.abs(d) > least), F.lit(False))
    return F.when(found & (d > 0), "hyper").when(found & (d < 0), "hypo").otherwise("unchanged")


def uniform(seed: int, *keys: Column | str) -> Column:
    """A uniform number in (0, 1) that depends on the keys as text and the seed alone, not on partitioning or engine. NULL keys are left out."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same for DuckDB, of whole numbers and strings."""
    return f"((('0x'||substr(md5(concat_ws(':','{seed}',{','.join(keys)})),1,13))::BIGINT+0.5::DOUBLE)/{1 << 52})"


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number by Box-Muller over two uniform ones."""
    u, v = uniform(2 * seed + 1, *keys), uniform(2 * seed + 2, *keys)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def normal_sql(seed: int, *keys: str) -> str:
    u, v = uniform_sql(2 * seed + 1, *keys), uniform_sql(2 * seed + 2, *keys)
    return f"(sqrt(-2*ln({u}))*cos(2*pi()*{v}))"


def gamma(seed: int, shape: int, *keys: Column | str) -> Column:
    """A gamma number of whole shape and scale 1: a sum of exponential ones."""
    return sum((-F.log(uniform(seed, *keys, F.lit(i))) for i in range(shape)), F.lit(0.0))


def beta(seed: int, a: int, b: int, *keys: Column | str) -> Column:
    """A beta number of whole shapes, from two gamma ones."""
    x, y = gamma(2 * seed + 1, a, *keys), gamma(2 * seed + 2, b, *keys)
    return x / (x + y)


def negative_binomial(seed: int, size: int, mean: float, *keys: Column | str) -> Column:
    """A negative binomial count of whole size and given mean: a sum of geometric ones."""
    fails = math.log(mean / (size + mean))
    return sum((F.floor(F.log(uniform(seed, *keys, F.lit(i))) / fails) for i in range(size)), F.lit(0)).cast("long")


def choice(seed: int, values: list, weights: list[float], *keys: Column | str) -> Column:
    """One of a few values, each as likely as its share of the weights."""
    u, total, out = uniform(seed, *keys), sum(weights), F.lit(values[-1])
    for i in reversed(range(len(values) - 1)):
        out = F.when(u < sum(weights[: i + 1]) / total, F.lit(values[i])).otherwise(out)
    return out
