"""Scalar functions on text columns: hosts, accounts, keys, encodings, redaction and indicators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What redaction masks, in this order, and the forms of indicators.
REDACTED = ("mimikatz", "invoke-?mimikatz", r"-enc(odedcommand)?\b", r"new-object\s+net\.webclient", "invoke-webrequest|wget|curl")
_ADDRESS = r"((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))"
# The value is the first group. Edges of words and blanks are those of ASCII; without case, the long s and the sign of Kelvin are letters s and k.
INDICATORS = {
    "url": r"(?i)(http[s\u017f]?://[^\t\n\f\r '\"<>]+)",
    "ip": rf"(?=\d)(?<!\d){_ADDRESS}(?!\d)",
    "hash": r"(?=[A-Fa-f0-9]{32})\b([A-Fa-f0-9]{32}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{64})\b",
    "path": r"([A-Za-z]:\\(?<![A-Za-z0-9_][A-Za-z]:\\)[^\t\n\f\r '\"<>|]+)",
    "domain": r"(?i)\b((?:[a-z0-9\x02\x03-]+\.)+(?:local|lan|internal|corp|com|net|org|io|co|[k\x03]r|dev|cloud|xyz))\b",
}
# Addresses that use up the character on each side, so that of two with one character between them the first is found.
APART = INDICATORS | {"ip": rf"(?=\d)(?:^|(?!\G)(?<!\d)){_ADDRESS}(?:\D|\z)"}
# Java's edges of words know letters of all scripts, so hashes and domains are looked for in texts whose other characters are one \x01.
_LONG_S_AND_KELVIN, _KEPT = "\u017f\u212a", "\x02\x03"
_MARKS = {"url": "://", "path": ":\\"}  # without which a text has none
HASH_KINDS = {32: "md5", 40: "sha1", 64: "sha256"}
WRAPPING = "\"'()[]{}<>.,; \t\r\n"


def host_name(value: Column) -> Column:
    """Lower case, without surrounding spaces and trailing dots."""
    return F.lower(F.regexp_replace(F.trim(value), r"\.+$", ""))


def short_host(value: Column) -> Column:
    return F.substring_index(host_name(value), ".", 1)


def account_leaf(value: Column) -> Column:
    r"""The bare account of ``DOMAIN\user``, ``domain/user`` and ``user@domain``, in lower case."""
    bare = F.substring_index(F.substring_index(value, "\\", -1), "/", -1)
    return F.lower(F.trim(F.substring_index(bare, "@", 1)))


def process_id(value: Column) -> Column:
    """A positive decimal or 0x hexadecimal number, else null."""
    text = F.lower(F.trim(value))
    hexadecimal = F.when(text.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(text, 3, 20), 16, 10).try_cast("long"))
    number = F.coalesce(hexadecimal, F.when(text.rlike(r"^\d{1,18}$"), text.try_cast("long")))
    return F.when(number > 0, number)


def strict_base64(value: Column) -> Column:
    """Bytes behind base64 without blanks and with its padding, of 8 characters or more; else null."""
    strict = value.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(value) >= 8) & (F.length(value) % 4 == 0)
    return F.try_to_binary(F.when(strict, value), F.lit("base64"))


def redact(value: Column) -> Column:
    """Fixed words are masked in the order of the list, and what looks like base64 is left out."""
    for pattern in REDACTED:
        value = F.regexp_replace(value, f"(?i){pattern}", "[REDACTED]")
    return F.regexp_replace(value, "[A-Za-z0-9+/=]{24,}", "[BASE64...REDACTED]")


def shorten(value: Column, size: int) -> Column:
    return F.when(F.char_length(value) > size, F.concat(F.substring(value, 1, size - 1), F.lit("…"))).otherwise(value)


def filled(value: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def letters(value: Column) -> Column:
    """Lower-cased letters and digits of any script, nothing else."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


# Texts that stand for no session.
NO_SESSION = ("0", "0x0", "-", "none", "null")


def session_id(value: Column) -> Column:
    """A session's number with hexadecimal ones in their shortest form; null for malformed and empty ones."""
    text, digits = F.trim(value), F.substring(F.trim(value), 3, 1000)
    short = F.regexp_replace(F.lower(digits), "^0+(?=.)", "")
    plain = F.when(F.lower(F.substring(text, 1, 2)) == "0x", F.when(digits.rlike("^[0-9A-Fa-f]+$"), F.concat(F.lit("0x"), short))).otherwise(text)
    return F.when(~F.lower(plain).isin("", *NO_SESSION), plain)


def service_name(value: Column) -> Column:
    return F.lower(F.btrim(value, F.lit("\"' \t\r\n")))


def command_text(value: Column) -> Column:
    """Lower case, blanks folded, without quotes at the ends."""
    return F.lower(F.btrim(F.regexp_replace(F.trim(value), r"\s+", " "), F.lit("\"'")))


def base_name(value: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(value), r"[\\/]"), -1))


def webkit_time(value: Column) -> Column:
    """ISO text in UTC of microseconds since 1601; empty for those that aren't positive."""
    return _iso(F.when(value > 0, value - 11644473600000000))


def unix_micros_time(value: Column) -> Column:
    return _iso(F.when(value > 0, value))


def unix_time(value: Column) -> Column:
    """ISO text in UTC of seconds since 1970; empty for those that aren't positive."""
    return _iso(F.when(value > 0, value.cast("long") * 1000000))


def _iso(micros: Column) -> Column:
    whole = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(micros, F.lit(1000000))
    return F.coalesce(F.concat(whole, F.when(part > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00")), F.lit(""))


def whole_number(value: Column) -> Column:
    """A decimal, hexadecimal, octal (0o) or binary (0b) whole number, null for other texts."""
    text = F.lower(F.trim(value))
    bare, sign = F.regexp_replace(text, "^[+-]", ""), F.when(text.startswith("-"), -1).otherwise(1)
    by_base = [F.when(bare.rlike(p), F.conv(F.substring(bare, 3, 64), b, 10)) for p, b in (("^0x[0-9a-f]{1,15}$", 16), ("^0o[0-7]{1,20}$", 8), ("^0b[01]{1,62}$", 2))]
    return F.coalesce(*by_base, F.when(bare.rlike("^(0+|[1-9][0-9]{0,17})$"), bare)).try_cast("long") * sign


def techniques_in(value: Column) -> Column:
    """Distinct technique codes of a list in text, with or without the prefix ATTACK., split by commas and blanks."""
    parts = F.transform(F.split(F.upper(value), r"[,;\s]+"), lambda p: F.regexp_replace(p, r"^ATTACK\.", ""))
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(r"^T\d{4}(\.\d{3})?$")))


def context(value: Column, matched: Column, around: int = 40) -> Column:
    """The first place of ``matched`` in ``value`` with so many code points on each side."""
    at = F.position(matched, value)
    start = F.greatest(F.lit(1), at - around)
    return F.substring(value, start, at - start + F.char_length(matched) + around)


def event_key(*columns: str) -> Column:
    """SHA-256 of fields joined by bars, nulls as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def indicators(text: Column, kinds: tuple[str, ...] = tuple(INDICATORS), patterns: dict[str, str] = INDICATORS) -> Column:
    """Array of (kind, value) for each indicator in a text, once per place."""

    def of(kind: str, ascii: Column) -> Column:
        found = F.regexp_extract_all(ascii if kind in ("hash", "domain") else text, F.lit(patterns[kind]), F.lit(1))
        if kind in _MARKS:
            found = F.when(F.contains(text, F.lit(_MARKS[kind])), found).otherwise(F.array().cast("array<string>"))
        if kind == "domain":
            found = F.transform(found, lambda v: F.lower(F.translate(v, _KEPT, _LONG_S_AND_KELVIN)))
        trimmed = F.filter(F.transform(found, lambda v: F.btrim(v, F.lit(WRAPPING))), lambda v: v != "")
        if kind != "hash":
            return F.transform(trimmed, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
        named = lambda v: F.when(F.length(v) == 32, HASH_KINDS[32]).when(F.length(v) == 40, HASH_KINDS[40]).otherwise(HASH_KINDS[64])
        return F.transform(trimmed, lambda v: F.struct(named(v).alias("kind"), F.lower(v).alias("value")))

    plain = (F.octet_length(text) == F.char_length(text)) & ~F.contains(text, F.lit(_KEPT[0])) & ~F.contains(text, F.lit(_KEPT[1]))
    ascii = F.when(plain, text).otherwise(F.regexp_replace(F.translate(text, _KEPT + _LONG_S_AND_KELVIN, "\x01\x01" + _KEPT), r"[^\x00-\x7F]+", "\x01"))
    return F.get(F.transform(F.array(ascii), lambda a: F.concat(*[of(kind, a) for kind in kinds])), F.lit(0))
