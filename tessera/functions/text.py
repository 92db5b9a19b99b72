"""Parsing and formatting of the small texts around rasters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(text: Column, n: int, separator: str = ",") -> Column:
    """array<double> of exactly n numbers; anything else raises."""
    parts = F.transform(F.split(text, separator), lambda x: F.trim(x).try_cast("double"))
    bad = (F.size(parts) != n) | F.exists(parts, lambda x: x.isNull())
    return F.when(~bad, parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} numbers: "), text)).cast("array<double>"))


def byte_count(n: Column, largest: str = "TiB") -> Column:
    """1.0 KiB, 142.2 GiB; whole bytes below that, no unit above the largest."""
    units = ("KiB", "MiB", "GiB", "TiB")
    out = F.format_string("%d B", n)
    for k, unit in enumerate(units[: units.index(largest) + 1], 1):
        out = F.when(n >= F.lit(1 << 10 * k), F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1 << 10 * k)), 1))).otherwise(out)
    return out


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 20)).otherwise(text)


def content_range(text: Column) -> Column:
    """struct(first, last, total) of ``bytes a-b/n``, null where it does not fit."""
    part = lambda k: F.regexp_extract(text, r"^bytes (\d+)-(\d+)/(\d+)$", k).try_cast("long")
    return F.when(part(3).isNotNull(), F.struct(part(1).alias("first"), part(2).alias("last"), part(3).alias("total")))


def md5_line(text: Column) -> Column:
    """The digest of an md5sum line, lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(text, r"^([0-9a-fA-F]{32})(\s|$)", 1)), F.lit(""))


def ms_and_fps(seconds: Column) -> Column:
    return F.when(seconds > 0, F.format_string("%.2f ms %.0f fps", seconds * 1000.0, 1.0 / seconds)).otherwise(F.lit("-"))


def mosaic_href(template: str, **parts: Column) -> Column:
    """A template with {name} fields filled from columns."""
    out = F.lit(template)
    for name, column in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), column.cast("string"))
    return out
