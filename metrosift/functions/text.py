"""Text, identifier and wording functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrosift.operators.checks import fail_when

# The URL namespace of RFC 4122 and the words an explanation may not use.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"
BANNED_WORDS = [
    "safe", "safety", "approved", "approval", "deploy", "deployment", "guarantee", "forecast",
]


def normalized_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def plain_text(html: Column) -> Column:
    """Tags become a space, then runs of white space one space."""
    return F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " ")


def section(text: Column, start: str, end: str | None = None) -> Column:
    """Text after the first ``start`` and before the next ``end``; null without ``start``."""
    at = F.instr(text, start)
    rest = F.substr(text, at + len(start))
    if end is not None:
        rest = F.substring_index(rest, end, 1)
    return F.when(at > 0, rest)


def holds_label(text: Column, label: Column) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lower(label)), F.lit(False))


def listed_status(serving: Column, upcoming: Column, label: Column, strict: bool = True) -> Column:
    """commercial or announced by the one section holding the label.

    In both or in neither is ambiguous: an error, or null when not strict.
    """
    now, soon = holds_label(serving, label), holds_label(upcoming, label)
    status = F.when(now, "commercial").otherwise("announced")
    if strict:
        return fail_when(now == soon, "Status is ambiguous or absent", status)
    return F.when(now != soon, status)


def content_id(value: Column, length: int = 20) -> Column:
    """Leading hex digits of the SHA-256 of the value's JSON form."""
    return F.substring(F.sha2(F.to_json(value), 256), 1, length)


def provenance_id(*fields: Column) -> Column:
    """Name-based (version 5) UUID in the URL namespace of the fields joined by ``|``."""
    name = F.encode(F.concat_ws("|", *fields), "UTF-8")
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), name))
    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab"]),
        F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1,
    )
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8), F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def query_parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def replace_host(url: Column, old: str, new: str) -> Column:
    """Swap the leading ``https://old/`` once; other addresses stay."""
    head = f"https://{old}/"
    return F.when(
        url.startswith(head), F.concat(F.lit(f"https://{new}/"), F.substr(url, F.lit(len(head) + 1)))
    ).otherwise(url)


def replace_suffix(version: Column, marker: str, suffix: Column) -> Column:
    """Cut the version at ``marker`` and append ``marker`` + suffix."""
    return F.concat(F.substring_index(version, marker, 1), F.lit(marker), suffix)


def acceptable_wording(
    summary: Column, cited: Column, allowed: Column, shortest: int = 20, longest: int = 600
) -> Column:
    """No digit of any script, banned word or line break; cited ids unique and all allowed."""
    summary = F.regexp_replace(summary, r"^\s+|\s+$", "")
    banned = r"(?i)\p{Nd}|\b(" + "|".join(BANNED_WORDS) + r")\b"
    return (
        ~summary.rlike(banned)
        & ~F.contains(summary, F.lit("\n"))
        & F.length(summary).between(shortest, longest)
        & F.size(cited).between(1, 100)
        & (F.size(F.array_distinct(cited)) == F.size(cited))
        & (F.size(F.array_except(cited, allowed)) == 0)
    )
