"""Text expressions: containment search, labels, currency and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillworks.schemas import NO, YES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(col: Column | str) -> Column:
    """Lower-case A-Z only; accented letters stay as they are."""
    return F.translate(col, _UPPER, _LOWER)


def like_pattern(text: Column | str) -> Column:
    """Pattern for "contains ``text``": % and _ in the text stay wildcards, backslash is plain."""
    return F.concat(F.lit("%"), F.replace(fold_ascii(text), F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def contains_text(col: Column | str, text: Column | str) -> Column:
    """Containment without regard to ASCII case. A plain string ``text`` is a literal."""
    needle = F.lit(text) if isinstance(text, str) else text
    return F.like(fold_ascii(col), like_pattern(needle))


def permission_label(col: Column | str) -> Column:
    """``ver_inventario`` -> ``Ver inventario``."""
    spaced = F.replace(F.col(col) if isinstance(col, str) else col, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.lower(F.substr(spaced, F.lit(2))))


def currency_text(amount: Column) -> Column:
    """``$`` and two decimals; exact, because the amount is a decimal. NULL reads as zero."""
    cents = F.coalesce(amount, F.lit(0)).cast("decimal(18,2)")
    return F.concat(F.lit("$"), cents.cast("string"))


def currency_grouped(amount: Column) -> Column:
    """Sheet style: thousands separators as well."""
    cents = F.coalesce(amount, F.lit(0)).cast("decimal(18,2)")
    return F.concat(F.lit("$"), F.format_number(cents, 2))


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit(YES)).otherwise(F.lit(NO))


def sha256_hex(col: Column | str) -> Column:
    return F.sha2(col, 256)
