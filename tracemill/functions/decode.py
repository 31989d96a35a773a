"""Decoding of hidden commands: encoded arguments, obfuscated scripts and macros, and what the result does.

All of it is column expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strict_base64

# Patterns that the decoders look for, and what each finding of theirs adds to the confidence.
ENCODED_ARGUMENT = r"(?i)-(?:enc|encodedcommand)\s*[:=]?\s*(?:'([^']+)'|\"([^\"]+)\"|([A-Za-z0-9+/=]{8,}))"
COMPRESSION = (r"\[IO\.Compression\.CompressionMode\]::Decompress", "GzipStream", "DeflateStream")
ENCODING_CHAIN = (r"\[System\.Text\.Encoding\]::\w+\.GetString", r"\[System\.Convert\]::FromBase64String")
EVALUATION = r"IEX\s*\(|Invoke-Expression"
ASSIGNED = r"""\$(\w+)\s*=\s*['"]([^'"]+)['"]"""
DECLARED = r"""(?is)Dim\s+(\w+)\s+As\s+\w+.*?=\s*["']([^"']+)["']"""
JOINED = r"""["']([^"']+)["']\s*&\s*["']([^"']+)["']"""
XOR_KEYS = (1, 2, 3, 5, 7, 13, 42, 255)
BEHAVIOURS = {
    "T1059.001": ("Invoke-Mimikatz", "Invoke-ReflectivePEInjection", "DownloadString", "DownloadFile", r"IEX\s*\("),
    "T1059.003": (r"cmd\.exe\s+/c", r"cmd\.exe\s+/k", "powershell.*-enc"),
    "T1003": ("Mimikatz", "lsadump", "sekurlsa", "wdigest", "kerberos"),
    "T1071": ("http[s]?://", r"WebClient\.DownloadString", r"WebClient\.DownloadFile", r"Net\.WebClient"),
    "T1105": ("DownloadString", "DownloadFile", "Invoke-WebRequest", "wget", "curl"),
    "T1083": ("Get-ChildItem", r"dir\s+/s", r"ls\s+-R"),
    "T1055": ("VirtualAlloc", "CreateRemoteThread", "WriteProcessMemory"),
}
BEHAVIOUR_CONFIDENCE = 0.8
ROUNDS = 5

_LOWER = "abcdefghijklmnopqrstuvwxyz"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out a single time however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _utf16(content: Column, little: bool) -> Column:
    """Text of UTF-16 bytes without a mark, null if they aren't such: surrogates must stand in pairs."""

    def paired(digits: Column) -> Column:
        high = F.transform(F.sequence(F.lit(1), F.length(digits) - 3, F.lit(4)), lambda i: F.substring(digits, i + (2 if little else 0), F.lit(2)))
        marks = F.array_join(F.transform(high, lambda h: F.when(h.between("D8", "DB"), "1").when(h.between("DC", "DF"), "2").otherwise("0")), "")
        return once(marks, lambda m: F.regexp_replace(m, "12", "") == F.regexp_replace(m, "[12]", ""))

    whole = (F.length(content) > 0) & (F.length(content) % 2 == 0)
    return F.when(F.when(whole, once(F.hex(content), paired)).otherwise(False), F.decode(content, "UTF-16LE" if little else "UTF-16BE"))


def _unless_blank(text: Column) -> Column:
    return once(text, lambda t: F.when(F.regexp_replace(t, r"\s", "") != "", t))


def base64_text(value: Column) -> Column:
    """Text behind strict base64 of 8 characters or more, spaces around it aside: UTF-8, else UTF-16; null if it is none or blank.

    Bytes that are both are read as UTF-8, so plain letters in UTF-16 keep their zeros.
    """

    def read(content: Column) -> Column:
        eight = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        return F.when(content.isNotNull(), F.coalesce(_unless_blank(eight), _unless_blank(_utf16(content, little=True))))

    return once(F.trim(value), lambda v: F.when(v.rlike("^[A-Za-z0-9+/]{6,}={0,2}$"), once(strict_base64(v), read)))


def encoded_arguments(command: Column) -> Column:
    """Decoded texts of all encoded arguments of a command line, in order."""
    tokens = [F.regexp_extract_all(command, F.lit(ENCODED_ARGUMENT), F.lit(k)) for k in (1, 2, 3)]
    joined = F.zip_with(F.zip_with(tokens[0], tokens[1], lambda a, b: F.concat(a, b)), tokens[2], lambda a, b: F.concat(a, b))
    bare = F.transform(joined, lambda t: F.regexp_extract(t, "^[A-Za-z0-9+/=]*", 0))
    return F.when(command.rlike("(?i)-enc"), F.array_compact(F.transform(bare, base64_text))).otherwise(F.array().cast("array<string>"))


def rotated(text: Column, n: int) -> Column:
    turned = _LOWER[n % 26 :] + _LOWER[: n % 26]
    return F.translate(text, _LOWER + _LOWER.upper(), turned + turned.upper())


def xored(text: Column, key: int) -> Column:
    """Every character's code point by exclusive or with a key below 256; defined for texts whose code points are below 128 each."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c != "", F.char(F.ascii(c).bitwiseXOR(F.lit(key))))), "")


def _substituted(text: Column, pattern: str, before: str, after: str) -> Column:
    """Names that ``pattern`` assigns are replaced by their last value in quotes, wherever they stand."""
    names, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    last = lambda n: F.element_at(F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: p["n"] == n), -1)["v"]
    quoted = lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r"([\\$])", r"\\$1"), F.lit('"'))
    return F.aggregate(F.array_distinct(names), text, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(before), n, F.lit(after)), quoted(last(n))))


def _result(kind: str, text: Column, found: list[tuple[str, Column, float]]) -> Column:
    names = F.array_compact(F.array(*[F.when(seen, F.lit(name)) for name, seen, _ in found]))
    confidence = sum((F.when(seen, F.lit(add)).otherwise(F.lit(0.0)) for _, seen, add in found), F.lit(0.0))
    return F.struct(F.lit(kind).alias("kind"), text.alias("decoded"), names.alias("techniques"), F.round(F.least(F.lit(1.0), confidence), 6).alias("confidence"))


def script(text: Column) -> Column:
    """(kind, decoded, techniques, confidence) of a shell script: base64 rounds, compression, substitution, encoding chains, evaluation."""
    start = F.struct(text.alias("text"), F.lit(0).alias("rounds"))
    step = lambda acc, _: once(base64_text(acc["text"]), lambda t: F.struct(F.coalesce(t, acc["text"]).alias("text"), (acc["rounds"] + t.isNotNull().cast("int")).alias("rounds")))
    unwrapped = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)

    def replaced(u: Column) -> Column:
        assigned = u["text"].rlike(ASSIGNED)
        final = F.when(assigned, _substituted(u["text"], ASSIGNED, r"\$\{?", r"\}?")).otherwise(u["text"])
        return once(final, lambda f: rated(u, f, assigned))

    def rated(u: Column, final: Column, assigned: Column) -> Column:
        found = [(f"base64 round {k + 1}", u["rounds"] > k, 0.2) for k in range(ROUNDS)]
        found += [("compression", u["text"].rlike(f"(?i){p}"), 0.1) for p in COMPRESSION]
        found.append(("substitution", assigned, 0.15))
        found += [("encoding chain", final.rlike(f"(?i){p}"), 0.1) for p in ENCODING_CHAIN]
        found.append(("evaluation", final.rlike(f"(?i){EVALUATION}"), 0.1))
        return _result("script", final, found)

    return once(unwrapped, replaced)


def _characters(text: Column, name: str, limit: int) -> Column:
    """Calls of a character function replaced by the character in quotes; codes above the limit stay."""
    calls = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?i)({name}\(\d+\))"), F.lit(1)))
    code = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    unit = lambda c: F.decode(F.unhex(F.lpad(F.hex(code(c)), 4, "0")), "UTF-16BE")
    fits = lambda c: code(c).between(0, limit) & ~code(c).between(0xD800, 0xDFFF)
    return F.aggregate(calls, text, lambda acc, c: F.when(fits(c), F.replace(acc, c, F.concat(F.lit('"'), unit(c), F.lit('"')))).otherwise(acc))


def macro(text: Column) -> Column:
    """(kind, decoded, techniques, confidence) of a macro: character functions, joined literals, declared variables."""

    def rated(one: Column, two: Column, three: Column) -> Column:
        declared = three.rlike(DECLARED)
        four = F.when(declared, _substituted(three, DECLARED, r"\b", r"\b")).otherwise(three)
        found = [
            ("character codes", text.rlike(r"(?i)Chr\(\d+\)"), 0.3), ("wide character codes", one.rlike(r"(?i)ChrW\(\d+\)"), 0.2),
            ("joined literals", two.rlike(JOINED), 0.2), ("declared variables", declared, 0.15),
        ]
        return _result("macro", four, found)

    joined = lambda one, two: once(F.regexp_replace(two, JOINED, '"$1$2"'), lambda three: rated(one, two, three))
    return once(_characters(text, "Chr", 255), lambda one: once(_characters(one, "ChrW", 65535), lambda two: joined(one, two)))


def plain_cipher(text: Column) -> Column:
    """(kind, decoded, techniques, confidence) by rotation, and by the first key whose result begins printable."""
    turned = rotated(text, 13)
    sample = F.substring(text, 1, 100)
    key = F.when(~sample.rlike(r"[^\x00-\x7f]"), F.coalesce(*[F.when(xored(sample, k).rlike(r"^[\x20-\x7e\r\n\t]+$"), F.lit(k)) for k in XOR_KEYS]))

    def rated(k: Column) -> Column:
        by_key = F.coalesce(*[F.when(k == n, xored(text, n)) for n in XOR_KEYS])
        found = [("rotation by 13", turned != text, 0.3)] + [(f"exclusive or with {n}", F.coalesce(k == n, F.lit(False)), 0.2) for n in XOR_KEYS]
        return _result("cipher", F.coalesce(by_key, turned), found)

    return once(key, rated)


def kind_of(text: Column) -> Column:
    low = F.lower(text)
    contains = lambda *parts: reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
    return F.when(contains("sub ", "function ", "dim "), "macro").when(contains("powershell", "invoke-", "$"), "script").otherwise("cipher")


def deobfuscated(text: Column, kind: Column | None = None) -> Column:
    """The most confident result of the decoder for the text's kind and of the plain ciphers, the former at a tie."""
    kind = kind_of(text) if kind is None else kind
    own = F.when(kind == "macro", macro(text)).when(kind == "script", script(text))
    best = lambda a: once(plain_cipher(text), lambda c: F.when(a.isNull() | (c["confidence"] > a["confidence"]), c).otherwise(a))
    return once(own, best)


def behaviours(text: Column) -> Column:
    """Array of (technique, pattern, confidence) that a decoded text shows, by the first pattern of each technique."""
    low = F.lower(text)

    def of(technique: str) -> Column:
        first = F.coalesce(*[F.when(low.rlike(f"(?i){p}"), F.lit(p)) for p in BEHAVIOURS[technique]])
        return F.when(first.isNotNull(), F.struct(F.lit(technique).alias("technique"), first.alias("pattern"), F.lit(BEHAVIOUR_CONFIDENCE).alias("confidence")))

    return F.array_compact(F.array(*map(of, BEHAVIOURS)))
