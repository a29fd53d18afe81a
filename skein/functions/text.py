"""Scalar functions on text, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest term of the code index, in bytes.
TERM_BYTES = 256


def round6(value: Column) -> Column:
    """Six decimals, halves away from zero, as the product is rounded (not the decimal expansion)."""
    return F.round(value * F.lit(1e6)) / F.lit(1e6)


#: What a term of the code index is made of: alphabetic, numeric, underscore (as Java and ``regex`` both write it).
TERM = r"[\p{IsAlphabetic}\p{N}_]+"


def code_terms(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower case character by character, at most 256 bytes each."""
    # a capital sigma stands alone here, so it has no final form; other capitals don't depend on what follows, and but for
    # a dotted I they stay one character: texts without these two are lower-cased whole
    found = lambda t: F.regexp_extract_all(t, F.lit(TERM), F.lit(0))
    terms = F.when(text.rlike("[Σİ]"), F.transform(found(text), lambda t: F.lower(F.translate(t, "Σ", "σ")))).otherwise(found(F.lower(text)))
    return F.when(F.octet_length(text) <= TERM_BYTES, terms).otherwise(F.transform(terms, cut_bytes))


def plain_code_terms(text: str) -> list[str]:
    """``code_terms`` for a text on the driver."""
    import regex

    def cut(term: str) -> str:
        out, size = "", 0
        for c in "".join(c.lower() for c in term):
            if size + len(c.encode()) <= TERM_BYTES:
                out, size = out + c, size + len(c.encode())
        return out

    return [cut(t) for t in regex.findall(TERM.replace("IsAlphabetic", "Alphabetic"), text)]


def cut_bytes(term: Column) -> Column:
    """At most TERM_BYTES bytes of UTF-8: characters that no longer fit are left out."""
    kept = F.aggregate(F.split(term, ""), F.lit(""), lambda out, c: F.when(F.octet_length(out) + F.octet_length(c) <= TERM_BYTES, F.concat(out, c)).otherwise(out))
    return F.when(F.octet_length(term) <= TERM_BYTES, term).otherwise(kept)


def ascii_lower(text: Column) -> Column:
    """Translating goes character by character, so texts that are all ASCII are lower-cased instead."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def wiki_terms(text: Column) -> Column:
    """Distinct runs of letters and digits, ASCII lower-case, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0)), ascii_lower))


def slug(text: Column) -> Column:
    """Lower-case letters and digits; other runs become one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+", "-"), r"^-+|-+$", "")


def escape_html(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def symbol_key(label: Column) -> Column:
    return F.lower(F.trim(label))


def last_segment(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def clean_label(text: Column) -> Column:
    """Without blanks around it, on one line."""
    return F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))


def parameter_label(text: Column) -> Column:
    """A parameter's name: what stands before its annotation or default, without stars."""
    return F.regexp_replace(F.trim(F.substring_index(F.substring_index(clean_label(text), ":", 1), "=", 1)), r"^\*+", "")


def is_iso_date(text: Column) -> Column:
    """By shape only."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def hrefs(text: Column) -> Column:
    """Targets of ``](...)``, in order."""
    return F.regexp_extract_all(text, F.lit(r"\]\(([^)]*)\)"), F.lit(1))


def link_scheme(href: Column) -> Column:
    """What stands before the first colon, if only scheme characters do; else null."""
    return F.when(href.rlike(r"^[A-Za-z0-9+.\-]*:"), F.regexp_extract(href, r"^([A-Za-z0-9+.\-]*):", 1))


#: Schemes that count as external links (fixed values).
SAFE_SCHEMES = ("http", "https", "mailto", "tel")


def link_kind(href: Column) -> Column:
    """rejected, external or internal, by the target's form alone."""
    trimmed, scheme = F.trim(href), link_scheme(F.trim(href))
    return (
        F.when(trimmed == "", "rejected")
        .when(trimmed.startswith("//"), "external")
        .when(F.lower(scheme).isin(*SAFE_SCHEMES), "external")
        .when(scheme.isNotNull(), "rejected")
        .otherwise("internal")
    )


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """The directory itself and all above it, from the root (an empty string)."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def normalize_path(base: Column, path: Column) -> Column:
    """``path`` seen from ``base``, without dots; null if it climbs above the root."""
    cleaned = F.replace(path, F.lit("\\"), F.lit("/"))
    start = F.when(cleaned.startswith("/"), F.array().cast("array<string>")).otherwise(F.filter(F.split(base, "/"), lambda p: p != ""))
    steps = F.filter(F.split(cleaned, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        steps,
        start,
        lambda done, p: F.when(done.isNull(), done)
        .when((p == "..") & (F.size(done) == 0), F.lit(None).cast("array<string>"))
        .when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(p))),
    )
    return F.array_join(walked, "/")


def glob_regex(pattern: str) -> str:
    """A wildcard pattern as a regular expression: ``*`` any run (slashes too), ``?`` one character."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def plain_pattern(pattern: str) -> str:
    """Without blanks around it and ``./`` before it, with slashes forward."""
    pattern = pattern.strip()
    while pattern.startswith("./"):
        pattern = pattern[2:]
    return pattern.replace("\\", "/")


def matches_glob(path: Column, pattern: str) -> Column:
    """``dir/`` means every path that starts with ``dir``; a pattern without a slash also matches the file name alone.

    ``?`` is one byte of UTF-8: where it occurs, bytes stand as ISO-8859-1 characters.
    """
    if not pattern.strip() or pattern.strip().startswith("#"):
        return F.lit(False)
    pattern = plain_pattern(pattern)
    if pattern.endswith("/"):
        return path.startswith(pattern.rstrip("/"))
    if "?" in pattern:
        path, pattern = F.decode(F.encode(path, "UTF-8"), "ISO-8859-1"), pattern.encode().decode("iso-8859-1")
    whole = path.rlike(glob_regex(pattern))
    return whole if "/" in pattern else whole | F.substring_index(path, "/", -1).rlike(glob_regex(pattern))


def matches_any(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | matches_glob(path, pattern)
    return out


def graph_id(prefix: str | Column, key: Column) -> Column:
    """``prefix:`` and the first 20 hexadecimal digits of the key's SHA-1."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, F.lit(":"), F.substring(F.sha1(key.cast("binary")), 1, 20))


def partition_id(path: Column) -> Column:
    return F.substring(F.sha1(path.cast("binary")), 1, 20)


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def percent_encode(text: Column) -> Column:
    """A URL path segment; a space becomes %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def block_value(value: Column) -> Column:
    """Bare if only plain characters, quoted as JSON otherwise."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.when(value.rlike(r"^[A-Za-z0-9_./:-]+$"), value).otherwise(quoted)


def block_span(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull(), F.concat(F.lit("L"), start.cast("string"), F.lit("-L"), F.coalesce(end, start).cast("string")))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters, and an ellipsis where more were cut."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def is_safe_path(path: Column) -> Column:
    """Relative, not of a drive, and without ``..`` between slashes of either kind."""
    return (path != "") & ~path.rlike(r"^[/\\]") & ~path.rlike("^[A-Za-z]:") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def repository_path(path: Column) -> Column:
    """With forward slashes and without ``.`` components; null if it is absolute, climbs or holds a colon."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", "."))
    return F.when(~plain.startswith("/") & ~F.array_contains(parts, "..") & ~F.contains(F.array_join(parts, "/"), F.lit(":")), F.array_join(parts, "/"))


def extension_terms(extensions: Column) -> Column:
    """``key value`` of each string, number and truth value of a JSON object, also of those in its arrays; sorted."""
    entries = F.map_entries(F.parse_json(extensions).cast("map<string,variant>"))
    kind = lambda v: F.call_function("schema_of_variant", v)
    scalar = lambda v: kind(v).rlike(r"^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$")
    values = lambda v: F.when(scalar(v), F.array(v)).when(kind(v).startswith("ARRAY"), F.call_function("try_variant_get", v, F.lit("$"), F.lit("array<variant>"))).otherwise(F.array().cast("array<variant>"))
    terms = F.transform(entries, lambda e: F.transform(F.filter(values(e["value"]), scalar), lambda v: F.concat(e["key"], F.lit(" "), v.cast("string"))))
    return F.array_sort(F.flatten(terms))
