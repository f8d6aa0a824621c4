"""Text columns: normalising, addresses, names, trigrams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Letters and signs that no rule below spells, with their ASCII spelling.
ASCII_SPELLING = {
    "Æ": "AE", "Ð": "D", "Þ": "Th", "ß": "ss", "ẞ": "SS", "æ": "ae", "ð": "d", "þ": "th", "ı": "i", "ĸ": "q", "ŉ": "'n",
    "Ŋ": "NG", "ŋ": "ng", "Œ": "OE", "œ": "oe", "ſ": "s", "Ə": "@", "ə": "@", "Ǝ": "3", "ǝ": "@", "Ɩ": "I", "Ƣ": "OI",
    "ƣ": "oi", "Ʀ": "YR", "Ʃ": "SH", "ƪ": "sh", "Ʊ": "Y", "Ʒ": "ZH", "Ƹ": "ZH", "ƹ": "zh", "ƺ": "zh", "Ƽ": "5", "ƽ": "5",
    "Ƅ": "6", "ƅ": "6", "Ƨ": "2", "ƨ": "2", "ƻ": "2", "Ɯ": "W", "ƍ": "d", "ƕ": "hv", "Ƕ": "HV", "ƾ": "ts", "ƿ": "w", "Ƿ": "W",
    "ǀ": "|", "ǁ": "||", "ǂ": "|=", "ǃ": "!", "Ȝ": "Y", "ȝ": "y", "Ȣ": "OU", "ȣ": "ou", "ȸ": "db", "ȹ": "qp", "Ɂ": "?",
    "ɂ": "?", "Ʌ": "V", "Ɣ": "G", "ẟ": "d", "ʒ": "zh", "ƛ": "l", "Ʉ": "U", "Ỻ": "LL", "ỻ": "ll",
    "¡": "!", "¢": "C/", "£": "PS", "¤": "$?", "¥": "Y=", "¦": "|", "§": "SS", "¨": '"', "©": "(c)", "«": "<<", "¬": "!",
    "\xad": "", "®": "(r)", "¯": "-", "°": "deg", "±": "+-", "´": "'", "µ": "u", "¶": "P", "·": "*", "¸": ",", "»": ">>",
    "¼": " 1/4 ", "½": " 1/2 ", "¾": " 3/4 ", "¿": "?", "×": "x", "÷": "/", "€": "EUR", "№": "No", "™": "tm",
    "‐": "-", "‑": "-", "–": "-", "—": "--", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": ",,", "…": "...",
}

# Cyrillic and Greek lower-case letters with their ASCII spelling; capitals follow from them.
SCRIPTS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "ѐ": "ie", "ё": "io", "ђ": "dj", "ѓ": "gj", "є": "ie",
    "ѕ": "dz", "і": "i", "ї": "yi", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "tsh", "ќ": "kj", "ѝ": "i", "ў": "u", "џ": "dzh", "ґ": "g",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n",
    "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}

# Spacing diacritics that the query normaliser drops besides the combining marks.
SPACING_DIACRITICS = "^`¨¯´·¸"

# Code points between the first characters of two units from which on a stretch is searched by itself.
FAR = 64

# White space as Python's str.strip and str.split see it, and as the trim of web browsers sees it.
WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
BROWSER_SPACE = "\t\n\x0b\x0c\r\u2028\u2029\ufeff" + "".join(
    chr(i) for i in range(0x3001) if unicodedata.category(chr(i)) == "Zs"
)

# Runs of white space other than a single plain blank; the same characters as in WHITE_SPACE.
RUN_OF_SPACE = r"(?U) [\s\x1c-\x1f]+|[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Accented characters below U+3000 and, at the same positions, their base characters."""
    accented, base = [], []
    for char in map(chr, range(0xC0, 0x3000)):
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and all(unicodedata.combining(mark) or unicodedata.category(mark)[0] == "M" for mark in parts[1:]):
            accented.append(char)
            base.append(parts[0])
    return "".join(accented), "".join(base)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """The value as text, '' for null."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def drop_accents(c: Column) -> Column:
    """Accented characters replaced by their base; plain ASCII text passes untouched."""
    accented, base = accent_table()
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, accented, base))


@lru_cache(maxsize=1)
def spelling() -> dict[str, str]:
    """The ASCII spelling of Latin, Cyrillic and Greek letters and common signs: from the tables, else of the compatible
    characters, else the letter that the character's name says is hooked, barred, turned or the like. An accented Cyrillic
    or Greek letter is spelled like its base.
    """
    found = {**ASCII_SPELLING, **SCRIPTS, **{char.upper(): ascii_.capitalize() for char, ascii_ in SCRIPTS.items() if char != "ς"}}
    for char, base in zip(*accent_table()):
        if base in found and not base.isascii():
            found.setdefault(char, found[base])
    ranges = [range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0xFB00, 0xFB07)]
    for char in (chr(i) for codes in ranges for i in codes):
        parts = "".join(part for part in unicodedata.normalize("NFKD", char) if not unicodedata.combining(part))
        parts = "".join(found.get(part, part) for part in parts)
        if not parts.isascii():
            named = re.match(r"LATIN (SMALL|CAPITAL) LETTER (?:[A-Z]+ )*?([A-Z])(?: WITH .*)?$", unicodedata.name(char, ""))
            parts = "" if not named else named[2].lower() if named[1] == "SMALL" else named[2]
        found.setdefault(char, parts)
    return found


def spell_ascii(c: Column) -> Column:
    """Latin, Cyrillic and Greek text and common signs in ASCII; other scripts stay as they are."""
    accented, base = accent_table()
    singles = {char: base_char for char, base_char in zip(accented, base) if char not in spelling()}
    singles |= {char: ascii_ for char, ascii_ in spelling().items() if len(ascii_) == 1}
    longer = {char: ascii_ for char, ascii_ in spelling().items() if len(ascii_) != 1}
    marked = F.regexp_replace(F.translate(c, "".join(singles), "".join(singles.values())), r"\p{M}", "")
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(spell_units(marked, longer))


def _code(char: str) -> str:
    return f"\\x{{{ord(char):x}}}"


def spell_units(c: Column, units: Mapping[str, str]) -> Column:
    """A text with units of one or several characters replaced, in one pass: at each place the longest unit that begins
    there, then from behind it. Nothing is replaced twice.
    """
    firsts = sorted({ord(unit[0]) for unit in units})
    by_length = sorted(units, key=lambda unit: (-len(unit), unit))
    several = ["".join(map(_code, unit)) for unit in by_length if len(unit) > 1]
    # A class costs a test for each of its members at each character. So stretches far from any unit's first character,
    # such as ASCII beside accented letters, have a class of their own, a single range.
    borders = zip([-1, *firsts], [*firsts, 0x110000])
    wide = [(after + 1, before - 1) for after, before in borders if before - after > FAR]
    between = "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in wide) + "".join(map(_code, map(chr, firsts)))
    stretches = [f"[\\x{{{first:x}}}-\\x{{{last:x}}}]+" for first, last in wide]
    pattern = "(?s)" + "|".join([*several, *stretches, f"[^{between}]+", "."])
    spelled = F.create_map(*[F.lit(part) for pair in units.items() for part in pair])
    pieces = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    # Long pieces are what stands between units.
    piece = lambda p: F.when(F.char_length(p) > len(by_length[0]), p).otherwise(F.coalesce(F.try_element_at(spelled, p), p))
    return F.array_join(F.transform(pieces, piece), "")


def normalize_index(c: Column | str) -> Column:
    """Search form of register text: ASCII, lower case, single blanks."""
    lowered = F.lower(spell_ascii(text_of(c)))
    return F.trim(F.regexp_replace(lowered, RUN_OF_SPACE, " "))


def normalize_query(c: Column | str) -> Column:
    """Search form of typed text: no diacritics, lower case, trimmed; inner blanks stay."""
    plain = F.regexp_replace(drop_accents(text_of(c)), rf"[\p{{M}}{SPACING_DIACRITICS[1:]}^]", "")
    return F.trim(F.lower(plain), F.lit(BROWSER_SPACE))


def is_blank(c: Column | str) -> Column:
    """Null, empty or nothing but white space."""
    return F.trim(text_of(c), F.lit(WHITE_SPACE)) == ""


def join_filled(*parts: Column | str) -> Column:
    """The parts that are not blank, as they are, with one space between them."""
    return F.concat_ws(" ", *[F.when(~is_blank(p), col(p).cast("string")) for p in parts])


def first_filled(*choices: Column | str) -> Column:
    """The first choice that is neither null nor '', else ''."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in choices], F.lit(""))


def search_text(*parts: Column | str) -> Column:
    """One normalised text to search a row by."""
    return normalize_index(F.concat_ws(" ", *[col(p) for p in parts]))


def label_text(c: Column | str) -> Column:
    return text_of(c)


def file_name_from_url(c: Column | str) -> Column:
    """Last part of the path, not counting slashes at its end."""
    return F.regexp_extract(col(c), "([^/]*)/*$", 1)


def long_enough(c: Column | str, least: int = 3) -> Column:
    """Whether typed text is worth searching for."""
    return F.char_length(F.trim(text_of(c), F.lit(BROWSER_SPACE))) >= least


def trigrams(c: Column | str) -> Column:
    """The set of 3-character substrings; empty for shorter texts."""
    text = col(c)
    length = F.char_length(text)
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    by_char = F.transform(
        F.arrays_zip(
            chars.alias("a"),
            F.slice(chars, 2, length).alias("b"),
            F.slice(chars, 3, length).alias("c"),
        ),
        lambda z: F.concat(z["a"], z["b"], z["c"]),
    )
    grams = F.slice(by_char, F.lit(1), length - 2)
    return F.when(length >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))
