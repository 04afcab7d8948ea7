"""Published Unicode ranges and the rule vocabularies built from them.

Every class is plain text in ``\\x{...}`` form, which java.util.regex (Spark) and RE2 (DuckDB) both read.
"""

from __future__ import annotations

# --- fixed values: Unicode property ranges --------------------------------------------------------
DEFAULT_IGNORABLE_RANGES = (
    "00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 "
    "FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"
)
BIDI_RANGES = "061C 200E-200F 202A-202E 2066-2069"
VARIATION_RANGES = "180B-180D 180F FE00-FE0F E0100-E01EF"
WHITESPACE_RANGES = "0009-000D 0020 0085 00A0 1680 2000-200A 2028-2029 202F 205F 3000"
LINE_TERMINATOR_RANGES = "000A 000D 0085 2028-2029"
UNSUPPORTED_CONTROL_RANGES = "0000-0008 000B-000C 000E-001F 007F-009F"
DASH_RANGES = "2010-2015"
PUNCTUATION_VARIANT_RANGES = (
    "00AB 00BB 2010-2015 2018-201F 2026 2212 FF01 FF0C FF0E FF1A FF1B FF1F"
)
EMOJI_RANGES = (
    "0023 002A 0030-0039 00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 "
    "23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 "
    "262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 "
    "269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA "
    "26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C "
    "274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D "
    "3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F "
    "1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 "
    "1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 "
    "1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 "
    "1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 "
    "1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA88 1FA90-1FABD "
    "1FABF-1FAC5 1FACE-1FADB 1FAE0-1FAE8 1FAF0-1FAF8"
)

# --- fixed values: protected-span, list-marker, word and URL patterns ------------------------------
EMAIL_LOCAL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]"
EMAIL_CORE = EMAIL_LOCAL + r"+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}"
# (kind, pattern, substrings of which every match holds one)
PROTECTED_PATTERNS = (
    ("CODE", r"`[^`\r\n]+`", ("`",)),
    ("EMAIL", EMAIL_CORE, ("@",)),
    ("URL", r"(?i)https?://[^\s<>]+", ("://",)),
    ("IDENTIFIER", r"(?<![\p{L}\p{N}_])[\p{L}_][\p{L}\p{N}_-]*_[\p{L}\p{N}_-]+(?![\p{L}\p{N}_])", ("_",)),
    ("CRYPTOGRAPHIC_STRING", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{24,}(?![A-Za-z0-9])", ()),
    ("MATHEMATICS", r"(?<!\w)\d+(?:\s*[+×÷=−]\s*\d+)+(?!\w)|(?<!\w)\d+–\d+(?!\w)", ("+", "×", "÷", "=", "−", "–")),
    ("QUOTED_LITERAL", r'"[^"\r\n]+"', ('"',)),
)
LIST_MARKER = r"^\s*(?:[-*+]|[0-9]+[.)])(?=\s)"
COLLISION_WORD = r"[\p{L}\p{N}_-]+"
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}\p{M}_]*(?:['’.][\p{L}\p{N}_][\p{L}\p{N}\p{M}_]*)*"
SCHEMELESS = (
    r"(?<![A-Za-z0-9@.-])(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}"
    r"(?::[0-9]{1,5})?(?:/[^\s<>()]*)?"
)
EMAIL = r"(?<!" + EMAIL_LOCAL + r")" + EMAIL_CORE + r"(?![A-Za-z0-9.-])"
TRAILING_PROSE = r"[.,;:!)\]}]+$"

# --- fixed values: script vocabulary (name -> regex script names) ----------------------------------
SCRIPTS = (
    ("LATIN", ("Latin",)),
    ("GREEK", ("Greek",)),
    ("CYRILLIC", ("Cyrillic",)),
    ("ARABIC", ("Arabic",)),
    ("HEBREW", ("Hebrew",)),
    ("DEVANAGARI", ("Devanagari",)),
    ("HAN", ("Han",)),
    ("HANGUL", ("Hangul",)),
    ("KANA", ("Hiragana", "Katakana")),
)
SHAPING_SCRIPTS = ("ARABIC", "DEVANAGARI")

# --- fixed values: look-alike letters (Cyrillic, Greek, Armenian, Cherokee -> Latin) ----------------
CONFUSABLE_FROM = "аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅοαρυνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧօոսհզցՏՕԼᎠᎡᎢᎪᎫᎬᎳᎷᎻᏃᏙᏢᏦᏞᏟ"
CONFUSABLE_TO = "aeopcyxijshdqwABEKMHOPCTXIJSoapuviABEZHIKMNOPTYXonuhqgSOLDRTAJEWMHZVPKLC"
# Full-width letters and digits look like the ASCII ones they stand 0xFEE0 behind.
_FULL_WIDTH = [c for c in range(0xFF10, 0xFF5B) if chr(c - 0xFEE0).isalnum()]
CONFUSABLE_FROM += "".join(map(chr, _FULL_WIDTH))
CONFUSABLE_TO += "".join(chr(c - 0xFEE0) for c in _FULL_WIDTH)
assert len(CONFUSABLE_FROM) == len(CONFUSABLE_TO)


def char_class(ranges: str, negate: bool = False) -> str:
    """``"200B-200D FEFF"`` -> ``[\\x{200B}-\\x{200D}\\x{FEFF}]``."""
    return f"[{'^' if negate else ''}{class_body(ranges)}]"


def class_body(ranges: str) -> str:
    parts = []
    for item in ranges.split():
        low, _, high = item.partition("-")
        parts.append(r"\x{%s}" % low + (r"-\x{%s}" % high if high else ""))
    return "".join(parts)


def searched_class(ranges: list[tuple[int, int]]) -> str:
    """A class of many ascending ranges for java.util.regex, which else tries one range after the other.

    Each part names the stretch it lies in first, so a character is tested against a few ranges of the whole list.
    """

    def node(part: list[tuple[int, int]]) -> str:
        if len(part) <= 4:
            return "".join(rf"\x{{{low:04X}}}-\x{{{high:04X}}}" for low, high in part)
        step = -(-len(part) // 4)
        parts = [part[at:at + step] for at in range(0, len(part), step)]
        return "".join(rf"[\x{{{p[0][0]:04X}}}-\x{{{p[-1][1]:04X}}}&&[{node(p)}]]" for p in parts)

    return f"[{node(ranges)}]"


def bounds(ranges: str) -> list[tuple[int, int]]:
    pairs = (item.partition("-") for item in ranges.split())
    return [(int(low, 16), int(high or low, 16)) for low, _, high in pairs]


WHITESPACE = char_class(WHITESPACE_RANGES)
LINE_TERMINATOR = char_class(LINE_TERMINATOR_RANGES)
INVISIBLE = "[" + class_body(DEFAULT_IGNORABLE_RANGES) + class_body(BIDI_RANGES) + r"\p{Cf}]"
EMOJI = char_class(EMOJI_RANGES)
EMOJI_SEARCHED = searched_class(bounds(EMOJI_RANGES))
# In a look-behind java.util.regex goes back as many UTF-16 units as the pattern is said to hold: two for these, by a branch that never matches.
EMOJI_BEFORE = rf"(?:{EMOJI_SEARCHED}|[^\s\S]{{2}})"
# A grapheme cluster that holds a non-ASCII character; plain ASCII is skipped character by character.
WIDE_CLUSTER = r"(?:(?=[^\x00-\x7F])|(?=[\x00-\x7F][\p{M}\x{200C}\x{200D}]))\X"
