"""Display and provider expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import segments


def percent_encoded(text: Column) -> Column:
    """RFC 3986: everything but letters, digits and -._~ is escaped."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def search_url(template: str, query: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{query}"), percent_encoded(query))


def short_path(path: Column) -> Column:
    """Of more than four segments the first and last two."""
    parts = segments(path)
    return F.when(F.size(parts) > 4, F.concat(F.array_join(F.slice(parts, 1, 2), "/"), F.lit("/…/"), F.array_join(F.slice(parts, -2, 2), "/"))).otherwise(path)


def short_title(title: Column, most: int = 48, head: int = 24, tail: int = 20) -> Column:
    return F.when(F.length(title) > most, F.concat(F.substring(title, 1, head), F.lit("…"), F.right(title, F.lit(tail)))).otherwise(title)


def command_safety(command: Column) -> Column:
    """blocked (removes the root), strong (needs a second confirmation) or allow."""
    text = F.lower(F.regexp_replace(command, r"^\s+|\s+$", ""))
    return F.when(text.rlike(r"^rm -rf /($| |\*)"), "blocked").when(text.rlike(r"^sudo |(^| )(mkfs|diskpart)"), "strong").otherwise("allow")
