"""Scalar functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"

#: What Markdown's marks become in plain text, in this order.
MARKDOWN = (
    (r"(?m)^\s*(```|~~~)[^\n]*$", " "),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^\s{0,3}#{1,6}\s+", ""),
    (r"(?m)^\s*>\s?", ""),
    (r"(?m)^\s{0,3}([-*_])(?:\s*\1){2,}\s*$", " "),
    (r"(?m)^\s*(?:[-+*]|\d+[.)])\s+", ""),
    (r"(?m)^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*$", " "),
    (r"(`+|\*\*|~~)", ""),
    (r"<[^>]+>", " "),
)

#: Phrases of views and exports; {n} is a number.
PHRASES = {
    "session": "Session",
    "start_time": "Start Time",
    "source": "Source",
    "session_id": "Session ID",
    "unknown_time": "Unknown time",
    "omitted": "{n} messages in the middle were omitted for safe display",
    "cut": "This message is too large; only the first {n} characters are shown",
}


def squeeze(c: Column) -> Column:
    """One space for each run of Unicode white space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def compact(c: Column, n: int) -> Column:
    """At most n characters of squeezed text; a cut one ends in three dots."""
    s = squeeze(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, max(0, n - 3)), F.lit("..."))).otherwise(s)


def compact_title(c: Column, n: int) -> Column:
    """The first line that isn't blank, without leading # and then >."""
    line = F.get(F.filter(F.split(c, "\n"), lambda x: squeeze(x) != ""), F.lit(0))
    return compact(F.coalesce(F.regexp_replace(F.regexp_replace(squeeze(line), "^#+", ""), r"^\s*>+", ""), F.lit("")), n)


def terms(query: str) -> list[str]:
    return query.lower().split()


def snippet(c: Column, query: str, width: int = 160, lead: int = 60) -> Column:
    """`width` characters from `lead` before the first hit of the whole query, else of the first term that has one; without a
    hit an empty string."""
    low = F.lower(c)
    hits = [F.locate(t, low) for t in dict.fromkeys([query.lower(), *terms(query)])]
    at = F.coalesce(*(F.when(h > 0, h) for h in hits))
    return F.when(at.isNull() & c.isNotNull(), "").otherwise(F.substring(low, F.greatest(at - lead, F.lit(1)), F.lit(width)))


def local_day(c: Column) -> Column:
    """The day of an RFC 3339 time in the session's zone; of anything else the first 10 bytes, if these are whole characters
    (null if they aren't, or if there are fewer)."""
    head = F.try_validate_utf8(F.substring(F.encode(c, "UTF-8"), F.lit(1), F.lit(10)).cast("string"))
    return F.when(c.rlike(RFC3339), F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd")).when(F.octet_length(c) >= 10, head)


def epoch_or_text(c: Column) -> Column:
    """Epoch milliseconds as an RFC 3339 time with milliseconds; other text as it is."""
    ms = F.when(c.rlike(r"^-?\d+$"), c.try_cast("long"))
    return F.when(ms.isNotNull(), F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).otherwise(c)


def basename(c: Column) -> Column:
    """The last part of a path with either separator; null if there is none."""
    name = F.regexp_extract(F.regexp_replace(c, r"[/\\]+$", ""), r"([^/\\]+)$", 1)
    return F.nullif(name, F.lit(""))


def canonical_path(c: Column) -> Column:
    """A path without scheme, doubled slashes and the parts `.` and `..`."""
    parts = F.filter(F.split(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/"), r"[/\\\\]+"), lambda p: ~p.isin("", "."))
    up = lambda done, p: F.when(p != "..", F.concat(done, F.array(p))).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def clip_bytes(c: Column, n: Column) -> Column:
    """As many whole characters as fit n bytes."""
    b = F.encode(c, "UTF-8")
    return F.coalesce(*(F.try_validate_utf8(F.substring(b, F.lit(1), F.greatest(n - i, F.lit(0))).cast("string")) for i in range(4)))


def lossy_text(c: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(c.cast("string"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def markdown_plain_text(c: Column) -> Column:
    """Text without Markdown's marks and tags, white space squeezed."""
    for pattern, to in MARKDOWN:
        c = F.regexp_replace(c, pattern, to)
    return squeeze(c)


def safe_link(c: Column) -> Column:
    """Whether a link may be shown: http, https, mailto or a fragment."""
    return F.coalesce(F.trim(c).rlike(r"(?i)^(https?:|mailto:|#)"), F.lit(False))


def valid_session_id(c: Column) -> Column:
    """A single path component."""
    return F.coalesce(c.rlike(r"^[^/\\:]+$") & ~c.isin(".", ".."), F.lit(False))


def valid_provider(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_.:-]{1,128}$"), F.lit(False))


def phrase(name: str, n: Column) -> Column:
    before, after = PHRASES[name].split("{n}")
    return F.concat(F.lit(before), n.cast("string"), F.lit(after))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def clip_utf16(c: Column, n: int) -> Column:
    """The characters that fit n UTF-16 units; a pair that would be cut in two is left out."""
    if n <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    units = F.encode(c, "UTF-16BE")
    first_of_pair = F.hex(F.substring(units, 2 * n - 1, 1)).between("D8", "DB")
    return F.decode(F.substring(units, F.lit(1), F.when(first_of_pair, 2 * n - 2).otherwise(2 * n)), "UTF-16BE")


def compact_text(c: Column, n: int = 90) -> Column:
    """At most n UTF-16 units of squeezed text; a cut one ends in three dots, without a space before them. Null is empty."""
    s = squeeze(F.coalesce(c, F.lit("")))
    return F.when(utf16_length(s) > n, F.concat(F.rtrim(clip_utf16(s, n - 3)), F.lit("..."))).otherwise(s)


def display_text(text: Column, truncated: Column, omitted: Column) -> Column:
    """What a view shows of a message: how many it stands for if `omitted` isn't null; a cut text says so below it."""
    cut = F.concat(text, F.lit("\n\n"), phrase("cut", utf16_length(text)))
    return F.when(omitted.isNotNull(), phrase("omitted", omitted)).when(truncated, cut).otherwise(F.coalesce(text, F.lit("")))


def display_time(c: Column) -> Column:
    """An RFC 3339 time as a reader's date and time in the session's zone; other text as it is, none as unknown."""
    t = F.when(c.rlike(RFC3339), F.try_to_timestamp(c))
    return F.coalesce(F.date_format(t, "MMM d, yyyy, h:mm:ss a"), blank_to_null(c), F.lit(PHRASES["unknown_time"]))


def starts_collapsed(role: Column, context: Column, shown: Column) -> Column:
    """Whether a view shows a message folded: a tool's, context, or more than 1,800 UTF-16 units of plain text."""
    return F.coalesce(role == "tool", F.lit(False)) | F.coalesce(context, F.lit(False)) | F.coalesce(utf16_length(markdown_plain_text(shown)) > 1800, F.lit(False))


def shown_kind(kind: Column, archived: Column, archive_source: Column) -> Column:
    """The source kind that a view groups by: archived sessions of the kind that keeps an archive are a kind of their own."""
    return F.when(F.coalesce(archived, F.lit(False)) & (archive_source == "codex"), "codex_archived").otherwise(F.coalesce(kind, F.lit("unknown")))
