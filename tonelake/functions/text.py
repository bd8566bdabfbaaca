"""Text expressions: identifiers, names, labels, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def strip_blanks(c: Column) -> Column:
    """Without spaces and tabs at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def id_key(c: Column) -> Column:
    """Comparison key of an identifier: no spaces or tabs at the ends, no case; null where nothing is left."""
    key = F.lower(strip_blanks(c))
    return F.when(key != "", key)


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0


def file_name(c: Column) -> Column:
    """Last part of a path with either separator."""
    return F.regexp_extract(c, r"([^/\\]+)$", 1)


def file_stem(c: Column) -> Column:
    return F.regexp_replace(file_name(c), r"\.[^.]*$", "")


def safe_name(c: Column, default: str = "unnamed_mix") -> Column:
    """Runs of characters outside A-Z a-z 0-9 . _ - become one underscore; `. _ -` are cut at the ends."""
    kept = F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.coalesce(F.when(kept != "", kept), F.lit(default))


def slug(c: Column) -> Column:
    """Letters and digits only, of any script."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def header_name(c: Column) -> Column:
    """Lower case, other characters than a-z 0-9 as single underscores."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), F.lit("_"))


def version_label(c: Column) -> Column:
    """A display label without blanks at the ends and without a leading word "Version" and the blanks after it."""
    return F.regexp_replace(strip_blanks(c), r"^(?i:version)[ \t]+", "")


def display_label(name: Column, identifier: Column) -> Column:
    """A name with its id in brackets, where there is one."""
    return F.when(is_blank(identifier), name).otherwise(F.concat(name, F.lit(" ("), identifier, F.lit(")")))


def song_key(artist: Column, song: Column) -> Column:
    return F.concat_ws(" - ", artist, song)


def low_slug(c: Column) -> Column:
    """Lower case, blanks as underscores."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def extension(c: Column) -> Column:
    """A file extension in lower case with exactly one leading dot."""
    return F.concat(F.lit("."), F.ltrim(F.lower(c), F.lit(".")))


def under_prefix(path: Column, prefix: str) -> Column:
    return F.coalesce(path.startswith(prefix), F.lit(False))


def first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """The value of the first rule that holds; a rule that is null does not hold."""
    out = None
    for condition, value in rules:
        ok = F.coalesce(condition, F.lit(False))
        out = F.when(ok, value) if out is None else out.when(ok, value)
    return F.lit(default) if out is None else out.otherwise(default)


def source_kind(code: Column, systems: list[str]) -> Column:
    """unknown for a blank code, automated for a listed system, else institution."""
    return first_rule([(is_blank(code), "unknown"), (code.isin(systems), "automated")], "institution")


def grouped_name(name: Column, rules: list[tuple[str, str, str]], excluded: str | None = None) -> Column:
    """struct(group, confidence): the first (pattern, group, confidence) that the name, in lower case without blanks, matches; null for excluded names."""
    plain = F.lower(F.replace(name, F.lit(" "), F.lit("")))
    found = F.lit(None).cast("struct<group:string,confidence:string>")
    for pattern, group, confidence in reversed(rules):
        found = F.when(plain.rlike(pattern), F.struct(F.lit(group).alias("group"), F.lit(confidence).alias("confidence"))).otherwise(found)
    return found if excluded is None else F.when(~plain.rlike(excluded), found)


def id_parts(c: Column, pattern: str, names: list[str]) -> Column:
    """struct of the groups that a pattern finds in an id; null where it does not match."""
    hit = c.rlike(pattern)
    return F.when(hit, F.struct(*(F.regexp_extract(c, pattern, k + 1).alias(n) for k, n in enumerate(names))))


def config_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(c, 256), 1, 16)
