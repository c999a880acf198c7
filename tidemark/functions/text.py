"""Text functions as column expressions: similarity, rounding, formats, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(x: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def string_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, else 1 - distance / longer length, never below 0 (DOUBLE)."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.levenshtein(a, b) / longer.cast("double")))


def round_score(x: Column) -> Column:
    """To one decimal, halves up, in DOUBLE."""
    return F.floor(x.cast("double") * 10 + F.lit(0.5)) / F.lit(10.0)


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union.cast("double"))


def safe_ratio(part: Column, rest: Column) -> Column:
    """part / (part + rest); null if both are zero."""
    return F.try_divide(part.cast("double"), (part + rest).cast("double"))


def format_bytes(x: Column) -> Column:
    """1024 steps from B to TB, one decimal but for bytes."""
    size = x.cast("double")
    out = F.format_string("%d B", x.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024.0**power, F.concat(F.format_string("%.1f", size / 1024.0**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_count(x: Column) -> Column:
    """Thousands as 1.2k, millions as 3.4M."""
    n = x.cast("double")
    return F.when(n >= 1e6, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M"))).when(n >= 1e3, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k"))).otherwise(x.cast("long").cast("string"))


def spreadsheet_safe(x: Column) -> Column:
    """A quote before cells that a spreadsheet would read as a formula."""
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over the characters (ASCII), as 8 hex digits."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    # 0x811c9dc5 and 0x01000193 are the algorithm's constants; products stay below 2^63
    h = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda acc, c: acc.bitwiseXOR(c) * F.lit(0x01000193).cast("long") % F.lit(1 << 32).cast("long"))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def normalized_query(x: Column) -> Column:
    """Comments out, literals and numbers as ?, white space collapsed, lower case."""
    bare = F.regexp_replace(F.regexp_replace(x, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"'(?:[^']|'')*'", "?"), r"\b\d+(?:\.\d+)?\b", "?"), r"\s+", " ")))


def query_fingerprint(x: Column) -> Column:
    return fnv1a(normalized_query(x))


def base_type(x: Column) -> Column:
    """A display type without its bracketed part: varchar(120)[] -> varchar[]."""
    return normalized(F.regexp_replace(x, r"\s*\([^)]*\)", ""))


def type_size(x: Column, part: int = 1) -> Column:
    """First (or second) number in the brackets of a display type; null without one."""
    return F.regexp_extract(x, r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", part).try_cast("int")


def narrows(before: Column, after: Column) -> Column:
    """Whether values may not fit any more: a smaller size, a size where none was, or fewer integer digits."""
    a, b = type_size(before), type_size(after)
    digits = lambda x: type_size(x) - F.coalesce(type_size(x, 2), F.lit(0))
    return (base_type(before) == base_type(after)) & F.coalesce(((a.isNull()) & b.isNotNull()) | (b < a) | (digits(after) < digits(before)) | (F.coalesce(type_size(after, 2), F.lit(0)) < F.coalesce(type_size(before, 2), F.lit(0))), F.lit(False))


def type_score(a: Column, b: Column) -> Column:
    """20 for the same type, 12 for the same base with another size, else 0."""
    return F.when(normalized(a) == normalized(b), 20.0).when(base_type(a) == base_type(b), 12.0).otherwise(0.0)


def rename_allowed(a: Column, b: Column) -> Column:
    """Plural forms of each other, or alike at 0.84 or more."""
    x, y = normalized(a), normalized(b)
    return (F.concat(x, F.lit("s")) == y) | (F.concat(y, F.lit("s")) == x) | (string_similarity(x, y) >= 0.84)
