"""Undoing of common obfuscation, as column functions: URL, octal, Base32, look-alike vowels, in this order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.let import let

#: The letters that count as each vowel (lower case; upper case follows).
VOWELS = {"a": "àáâãäåāăąǎȁȃȧæ", "e": "èéêëēĕėęěȅȇ", "i": "ìíîïīĭįǐȉȋ", "o": "òóôõöøōŏőǒȍȏ", "u": "ùúûüūŭůűǔȕȗ"}
FOLD_FROM = "".join(v + v.upper() for v in VOWELS.values())
FOLD_TO = "".join(k * len(v) + k.upper() * len(v) for k, v in VOWELS.items())
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _digits(of=lambda v: True, more: str = "") -> str:
    """A class of the Base32 digits whose value passes, in either case; each by itself, as Java looks such classes up in a table."""
    kept = "".join(c for v, c in enumerate(_ALPHABET) if of(v))
    return f"[{kept}{''.join(c.lower() for c in kept if c.isalpha())}{more}]"


# Of eight digits five bytes come: their top bits lie in the digits 0, 1, 3, 4 and 6, and the first byte is 32 at least. Most
# words fail this, and are no Base32 of printable bytes, so they are no match to begin with.
_BASE32 = (
    f"(?<!{_digits(more='=')})" + _digits(lambda v: 4 <= v < 16) + _digits(lambda v: not v & 2) + _digits() + _digits(lambda v: not v & 8)
    + _digits(lambda v: not v & 1) + _digits() + _digits(lambda v: not v & 4) + f"{_digits()}+={{0,6}}(?!{_digits(more='=')})"
)


def replaced(text: Column, regex: str, change) -> Column:
    """text with every match of regex replaced by change(match)."""

    def of(t):
        pieces, hits = F.split(t, regex, -1), F.regexp_extract_all(t, F.lit(f"({regex})"), F.lit(0))
        both = F.zip_with(pieces, F.transform(hits, change), lambda p, d: F.concat(p, F.coalesce(d, F.lit(""))))
        return F.when(t.rlike(regex), F.array_join(both, "")).otherwise(t)

    return let(text, of)


def _marks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\uFFFD"), F.lit("")))


def url_decoded(text: Column) -> Column:
    """Up to five rounds; a text with any malformed sequence stays as it is."""

    def round_(t):
        def kept(plain):
            return F.when(plain.isNotNull() & (_marks(plain) <= _marks(t)), plain).otherwise(t)

        return F.when(t.contains("%") & ~t.rlike(r"%(?![0-9A-Fa-f]{2})"), let(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), kept)).otherwise(t)

    for _ in range(5):
        text = let(text, round_)
    return text


def octal_decoded(text: Column) -> Column:
    """\\ddd becomes its character, up to \\777."""
    code = lambda m: F.lpad(F.conv(F.substring(m, 2, 3), 8, 16), 4, "0")
    return replaced(text, r"\\[0-7]{3}", lambda m: F.decode(F.unhex(code(m)), "UTF-16BE"))


def base32_decoded(text: Column) -> Column:
    """Runs of eight or more Base32 characters become text where every byte of it is printable."""

    def decode(m):
        clean = F.upper(F.replace(m, F.lit("="), F.lit("")))
        bits = F.array_join(F.transform(F.split(clean, ""), lambda c: F.lpad(F.bin(F.instr(F.lit(_ALPHABET), c) - 1), 5, "0")), "")
        numbers = lambda b: F.transform(F.sequence(F.lit(0), F.floor(F.length(b) / 8).cast("int") - 1), lambda i: F.conv(F.substring(b, i * 8 + 1, F.lit(8)), 2, 10).cast("int"))
        printable = lambda codes: (F.size(codes) >= 4) & F.forall(codes, lambda c: (c >= 32) & (c <= 126))
        return let(let(bits, numbers), lambda codes: F.when(printable(codes), F.array_join(F.transform(codes, F.char), "")).otherwise(m))

    return replaced(text, _BASE32, decode)


def vowels_folded(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def normalised(text: Column) -> Column:
    return vowels_folded(base32_decoded(octal_decoded(url_decoded(text))))
