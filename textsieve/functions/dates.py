"""Date parsing as column expressions; unreadable dates become null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts accepted in feeds and exports, tried in this order.
MIXED_LAYOUTS = [
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss z",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss",
    "dd/MM/yyyy",
    "yyyy-MM-dd",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_mixed(c, layouts: Sequence[str] = MIXED_LAYOUTS) -> Column:
    """Instant in UTC. The weekday of an RFC 2822 date carries no information and is cut off."""
    bare = F.regexp_replace(_col(c), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)) for p in layouts])


def publication_year(date_text, url) -> Column:
    """Year of a ``dd/mm/yyyy`` date in the text, else of a ``/20dd/`` step in the address."""
    day = F.regexp_extract(_col(date_text), r"([0-9]{2}/[0-9]{2}/[0-9]{4})", 1)
    from_text = F.year(F.try_to_timestamp(day, F.lit("dd/MM/yyyy")))
    readable = F.when(from_text.between(1678, 2261), from_text)
    step = F.regexp_extract(_col(url), r"/(20[0-9]{2})/", 1)
    return F.coalesce(readable, F.when(step != "", step).cast("int"))


def on_or_after(ts, label, cutoffs: dict[str, str]) -> Column:
    """Publication cut-off that depends on the class; a null time fails."""
    rule = F.lit(False)
    for name, instant in cutoffs.items():
        rule = F.when(_col(label) == name, _col(ts) >= F.lit(instant).cast("timestamp")).otherwise(rule)
    return F.coalesce(rule, F.lit(False))
