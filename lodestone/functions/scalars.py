"""Scalar rules as column expressions. White space is spelled out, as engines differ on what \\s covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \\t\\n\\r\\f\\x0B]"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def slugify(title: Column) -> Column:
    """Lower case; ASCII letters, digits, '_' and '-' stay, blanks become '-'; 60 long at most, no '-' at the end."""
    kept = F.regexp_replace(F.lower(title), "[^a-z0-9_ -]", "")
    return F.regexp_replace(F.substring(F.regexp_replace(kept, " ", "-"), 1, 60), "-+$", "")


def note_key(created: Column, title: Column, salt: Column) -> Column:
    """created-slug-suffix; the suffix is four hex digits of the salt's sha256, so that reruns agree."""
    return F.concat_ws("-", created, slugify(title), F.substring(F.sha2(salt.cast("binary"), 256), 1, 4))


def source_segment(source: Column) -> Column:
    flat = F.regexp_replace(F.trim(source), "[^a-zA-Z0-9._-]+", "-")
    return F.coalesce(F.substring(F.regexp_replace(flat, "^[-.]+|[-.]+$", ""), 1, 80), F.lit(""))


def note_path(kind_folder: Column, id: Column, source: Column) -> Column:
    segment = source_segment(source)
    return F.concat(F.when(segment != "", F.concat(segment, F.lit("/"))).otherwise(""), kind_folder, F.lit("/"), id, F.lit(".md"))


def repo_slug(remote: Column) -> Column:
    """owner/repo of a git remote; null if nothing is left."""
    s = F.regexp_replace(F.trim(remote), "(?i)\\.git$", "")
    s = F.regexp_replace(F.regexp_replace(s, "(?i)^[a-z]+://", ""), "^[^@]+@", "")
    s = F.regexp_replace(s, "^[^/:]+[:/]", "")
    parts = F.filter(F.split(s, "/"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), 2), "/"))


def unlink(ref: Column) -> Column:
    return F.regexp_replace(ref, "^\\[\\[|\\]\\]$", "")


def days_between(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.datediff(F.try_to_date(now), F.try_to_date(then)), F.lit(0)))


def inline_text(value: Column) -> Column:
    """One line that can't form a link or code span, 200 long at most."""
    return F.substring(collapse(F.regexp_replace(F.regexp_replace(value, "[\\r\\n]+", " "), "([\\[\\]`])", "\\\\$1")), 1, 200)


def gist(body: Column, most: int = 160) -> Column:
    """The first line that isn't blank or a heading."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")))
    return F.substring(F.coalesce(F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), F.lit(0)), F.lit("")), 1, most)


def first_line(body: Column, most: int = 120) -> Column:
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", ""))
    return F.substring(F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit("")), 1, most)


def excerpt(body: Column, most: int = 320) -> Column:
    line = collapse(body)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def human_age(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))


def is_under(child: Column, parent: Column) -> Column:
    return (child == parent) | F.startswith(child, F.concat(parent, F.lit("/")))


def identity_key(email: Column, name: Column) -> Column:
    clean = F.when(F.lower(F.trim(email)).rlike("^[^@ ]+@[^@ ]+$"), F.lower(F.trim(email)))
    return F.sha2(F.coalesce(clean, F.lower(collapse(name))).cast("binary"), 256)


def contributor_id(name: Column, key: Column) -> Column:
    return F.concat(slugify(name), F.lit("-"), F.substring(key, 1, 10))


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def percent_text(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "—").otherwise(F.concat(round_half_up(ratio * 100).cast("string"), F.lit("%")))


def trend_arrow(trend: Column) -> Column:
    return F.when(trend == "up", "↑ improving").when(trend == "down", "↓ declining").when(trend == "flat", "→ steady").otherwise("· no prior window")


def bar(n: Column, most: Column, cells: int = 24) -> Column:
    return F.when(n > 0, F.repeat(F.lit("█"), F.greatest(F.lit(1), round_half_up(n * cells / most)).cast("int"))).otherwise("")
