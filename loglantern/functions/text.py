"""Text shaping. Lengths in filters and histograms are bytes; cuts are in characters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fragments that mark a message as noise, matched with their case.
NOISE_SEMANTIC = ("assertion failed", "Statistics:")
NOISE_KEYWORD = ("assertion failed", "Statistics:", "--enable-")
LONG_MESSAGE_BYTES = 80


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def not_empty(text: Column | str) -> Column:
    return _column(text) != ""


def longer_than(text: Column | str, n_bytes: int = LONG_MESSAGE_BYTES) -> Column:
    return F.octet_length(_column(text)) > n_bytes


def without_any(text: Column | str, fragments: Sequence[str]) -> Column:
    """True when none of the fragments occurs, case-sensitively."""
    col = _column(text)
    keep = F.lit(True)
    for fragment in fragments:
        keep = keep & ~col.contains(fragment)
    return keep


def strip(text: Column | str) -> Column:
    """Remove white space of any kind from both ends; ``trim`` alone keeps tabs and newlines."""
    return F.regexp_replace(_column(text), r"^\s+|\s+$", "")


def not_blank(text: Column | str) -> Column:
    """True when a character other than white space occurs."""
    return _column(text).rlike(r"\S")


def prefix(text: Column | str, n: int, ellipsis: bool | None = None) -> Column:
    """First ``n`` characters. ``ellipsis``: None adds no dots, True always, False only after a cut."""
    col = _column(text)
    cut = F.substring(col, 1, n)
    if ellipsis is None:
        return cut
    dotted = F.concat(cut, F.lit("..."))
    return dotted if ellipsis else F.when(F.length(col) > n, dotted).otherwise(cut)


def one_line(text: Column | str, n: int = 160) -> Column:
    """First ``n`` characters with newlines shown as spaces."""
    return F.translate(F.substring(_column(text), 1, n), "\n", " ")


def percent(share: Column | str, digits: int = 1) -> Column:
    """A share as a percentage. What is rounded is the product in doubles, as SQL engines do; ``round(x, 1)`` goes by the
    shortest decimal of x instead and takes 54.949999999999996 for less than half."""
    scale = 10.0**digits
    return F.round(_column(share) * 100 * scale) / scale


def length_bucket(text: Column | str, width: int = 100) -> Column:
    """Lower bound of the byte-length bucket, in whole-number arithmetic."""
    size = F.octet_length(_column(text))
    return size - size % width


def minute_key(timestamp: Column | str) -> Column:
    """Minute part of a timestamp held as text (``yyyy-MM-dd HH:mm...``)."""
    return F.substring(_column(timestamp), 1, 16)


def year_month(timestamp: Column | str) -> Column:
    """Calendar month as the number ``yyyymm``; cheaper to compute and to prune on than text."""
    col = _column(timestamp)
    return F.year(col) * 100 + F.month(col)


def log_text(
    source: Column | str = "source",
    level: Column | str = "level",
    message: Column | str = "message",
    metadata: Column | str | None = "metadata",
) -> Column:
    """``Source: s | Level: l | Message: m | k: v ...``; a map has no order, so keys are sorted."""
    head = [
        F.concat(F.lit(f"{name}: "), F.coalesce(_column(col), F.lit("")))
        for name, col in (("Source", source), ("Level", level), ("Message", message))
    ]
    if metadata is None:
        return F.concat_ws(" | ", *head)
    entries = F.array_sort(F.map_entries(_column(metadata)))
    pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    # concat_ws skips nulls and spreads arrays, so a null or empty map adds nothing.
    return F.concat_ws(" | ", *head, pairs)


def segment_after(text: Column | str, marker: str) -> Column:
    """The part between the first marker and the next `` |``; null when the marker is absent."""
    col = _column(text)
    tail = F.split_part(col, F.lit(marker), F.lit(2))
    return F.when(col.contains(marker), F.split_part(tail, F.lit(" |"), F.lit(1)))


def parse_source(text: Column | str) -> Column:
    return segment_after(text, "Source: ")


def parse_level(text: Column | str) -> Column:
    return segment_after(text, "Level: ")


def to_timestamp_utc(text: Column | str) -> Column:
    """ISO text to an instant; a ``Z`` or an offset is honoured, unparseable text becomes null."""
    return _column(text).try_cast("timestamp")


def fetch(mapping: Column | str, key: str, default: str) -> Column:
    """Value of a map key, or ``default`` when the key is missing."""
    return F.coalesce(F.try_element_at(_column(mapping), F.lit(key)), F.lit(default))
