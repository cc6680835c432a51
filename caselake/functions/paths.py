"""Columns derived from paths and file names: keys, folders, channels, pairs, kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_path(path: Column) -> Column:
    """The path without a Windows long-path prefix."""
    return F.regexp_replace(path, r"^\\\\\?\\(?:UNC\\)?", "")


def path_key(path: Column, raw_hex: Column | None = None) -> Column:
    """Identity of a path: its display form, and behind a NUL the raw bytes where they are not Unicode."""
    key = display_path(path)
    return key if raw_hex is None else F.when(F.coalesce(raw_hex, F.lit("")) != "", F.concat(key, F.lit("\0"), raw_hex)).otherwise(key)


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def dir_path(path: Column) -> Column:
    """The folder, with slashes; empty for a bare name."""
    return F.regexp_extract(slashed(path), r"^(.*)/[^/]*$", 1)


def parent_dir(path: Column) -> Column:
    """The last folder's name, 'Root' if there is none."""
    name = F.element_at(F.split(dir_path(path), "/"), -1)
    return F.when(F.coalesce(name, F.lit("")) == "", "Root").otherwise(name)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def channel_code(name: Column) -> Column:
    """F, R, I or B: a separated letter in the name, else front, rear, interior or inside; else null."""
    text = F.concat(F.lit(" "), name)
    letter = F.upper(F.regexp_extract(text, r"(?i)[_\-. ]([FRIB])(?:[_.\- ]|[a-z0-9]*$)", 1))
    low = F.lower(text)
    words = F.when(low.contains("front"), "F").when(low.contains("rear"), "R").when(low.rlike("interior|inside"), "I")
    return F.when(letter != "", letter).otherwise(words)


def pair_key(path: Column) -> Column:
    """folder|name without its channel token, in lower case; empty if nothing of the name is left."""
    base = F.lower(F.regexp_replace(base_name(path), r"\.[^.]*$", ""))
    base = F.regexp_replace(base, "front|rear|interior|inside", "")
    base = F.regexp_replace(base, r"[_\-. ][frib](?=$|[_\-. ])", "")
    base = F.regexp_replace(base, r"^[ _\-.]+|[ _\-.]+$", "")
    return F.when(base == "", "").otherwise(F.concat(F.lower(dir_path(path)), F.lit("|"), base))


#: Keywords of the recording kinds, the first that fits wins.
KINDS = (("event", "event|충격|사고|impact"), ("parking", "parking|주차"), ("driving", "driving|주행|상시|continuous|normal"))


def rec_type(path: Column) -> Column:
    """event, parking or driving by keyword, else empty."""
    out = F.lit("")
    for kind, words in reversed(KINDS):
        out = F.when(F.lower(path).rlike(words), kind).otherwise(out)
    return out


def prefix(name: Column) -> Column:
    """The name's first run of letters, without trailing separators; 'other' if there is none."""
    found = F.regexp_replace(F.regexp_extract(name, r"[A-Za-z가-힣_\-]+", 0), r"[_\-]+$", "")
    return F.when(found == "", "other").otherwise(found)


def search_haystack(*fields: Column) -> Column:
    """The fields in lower case, joined by NUL, which no query holds: a substring search stays within a field."""
    return F.lower(F.concat_ws("\0", *fields))


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits compare as numbers: each stands behind the count of its digits."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    padded = F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lpad(F.length(F.regexp_replace(p, r"^0+(?=\d)", "")).cast("string"), 10, "0"), F.regexp_replace(p, r"^0+(?=\d)", ""))).otherwise(p))
    return F.concat_ws("", padded)
