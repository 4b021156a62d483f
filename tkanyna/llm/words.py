"""Text as a reader sees it: the usual form of a value, its words, and fixed-width keys of them.

The usual form has ordinary spaces, composed letters, half-width characters, no invisible characters, U+0027 inside
words and every word in its own alphabet. Everything here is a plain function of one string, so the operators can call
it inside an Arrow batch; null and empty strings give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import xxhash

# Characters that look alike, in the order Latin, Cyrillic.
LATIN = "aceiopxyABCEHIKMOPTXï"
CYRILLIC = "асеіорхуАВСЕНІКМОРТХї"
# Greek characters and the Cyrillic and Latin ones they look like.
GREEK = "αιορχυκΑΒΕΗΙΚΜΟΡΤΧ"
GREEK_CYRILLIC = "аіорхукАВЕНІКМОРТХ"
GREEK_LATIN = "aiopxykABEHIKMOPTX"
# Marks used as an apostrophe, and characters without a shape that Unicode counts as letters or marks.
APOSTROPHES = "\u2019\u2018\u02bc\u02b9`\u00b4\u2032\u201b"
BLANKS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
# Format characters that are seen.
SEEN_FORMATS = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2"
STRESS = "\u0301"

TO_CYRILLIC = str.maketrans(LATIN + GREEK, CYRILLIC + GREEK_CYRILLIC)
TO_LATIN = str.maketrans(CYRILLIC + GREEK, LATIN + GREEK_LATIN)
#: Latin letters with an acute, as a look-alike and a stress mark.
STRESSED = {ord(unicodedata.normalize("NFC", c + STRESS)): c + STRESS for c in "aeioyAEIO"}


def invisible(char: str) -> bool:
    """Whether a character has no shape: format characters, variation selectors, fillers."""
    code = ord(char)
    return unicodedata.category(char) == "Cf" and char not in SEEN_FORMATS and code < 0x10000 or char in BLANKS or 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code <= 0xE01EF


class Shapes(dict):
    """What each character looks like, worked out from its Unicode properties when it is first met.

    Spaces of any kind are U+0020, invisible characters nothing; letters and digits that are wide, narrow, of a
    mathematical font or a ligature are what they stand for. Superscripts, signs and the micro sign stay.
    """

    def __missing__(self, code: int) -> int | str | None:
        char = chr(code)
        kind, parts = unicodedata.category(char), unicodedata.decomposition(char)
        if kind == "Zs" or code in (0x85, 0x2028, 0x2029):
            found = " "
        elif invisible(char):
            found = None
        elif code in (0x2010, 0x2011):
            found = "-"
        elif parts.startswith(("<wide>", "<narrow>")) or kind[0] in "LN" and code != 0xB5 and parts.startswith(("<font>", "<compat>")) and kind != "No":
            found = unicodedata.normalize("NFKC", char)
        else:
            found = code
        self[code] = found
        return found


SHAPES = Shapes()

#: Values made of these characters only are in the usual form, but for Cyrillic words that stand for Latin ones.
PLAIN = re.compile(r"[ \t\n\rа-щьюяА-ЩЬЮЯіїєґІЇЄҐыэъёЫЭЪЁ0-9.,!?:;'\"«»“”„()\[\]—–…№²\u0301-]*")
ROMANLIKE = re.compile(r"(?<![^\W\d_])[ХІ]{2,}(?![^\W\d_])|°[СC]")
TOKEN = re.compile(r"(?:[^\W_]|[\u0300-\u036f])+(?:'(?:[^\W_]|[\u0300-\u036f])+)*")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
APOSTROPHE = re.compile(rf"(?<=[^\W\d_])[{APOSTROPHES}](?=[^\W\d_])|(?<=[^\W\d_]\u0301)[{APOSTROPHES}](?=[^\W\d_])")
ROMAN = re.compile(r"(?=[IVXLCDM])M{0,3}(?:C[MD]|D?C{0,3})(?:X[CL]|L?X{0,3})(?:I[XV]|V?I{0,3})")
ONLY_CYRILLIC = re.compile(f"[^{CYRILLIC}\\W\\d_]")
CYRILLIC_ONLY = re.compile(f"[\u0400-\u052f](?<![{CYRILLIC}])")
LATIN_ONLY = re.compile(f"[a-zA-Z](?<![{LATIN}])")
LATIN_ACUTE = re.compile("[A-Za-z\u00c0-\u024f]\u0301")
ALIKE = frozenset(LATIN + CYRILLIC + GREEK)


def script_of(char: str) -> str:
    """C, L, G or empty: the alphabet of a letter."""
    code = ord(char)
    if 0x400 <= code < 0x530:
        return "C"
    if code < 0x250 and char.isalpha():
        return "L"
    return "G" if 0x370 <= code < 0x400 else ""


def composed(text: str) -> str:
    """Letters in one character; a stress mark stays a character of its own, but for Latin words (see `usual_form`)."""
    if STRESS in text:
        return STRESS.join(unicodedata.normalize("NFC", part) for part in text.split(STRESS))
    return unicodedata.normalize("NFC", text)


def accented(text: str) -> str:
    """With Latin letters and an acute in one character."""
    return LATIN_ACUTE.sub(lambda m: unicodedata.normalize("NFC", m.group()), text) if STRESS in text else text


def shaped(text: str) -> str:
    """The text with ordinary spaces, widths, apostrophes and composed letters; alphabets are left as they are."""
    return APOSTROPHE.sub("'", composed(text.translate(SHAPES)))


@lru_cache(maxsize=100_000)
def alphabet(token: str, before: str = "", latin_beside: bool = False) -> tuple[str, bool]:
    """The token in the alphabet its letters call for, and whether they leave that open.

    before: the character in front of it. latin_beside: a hyphen joins it to a Latin word, or all words around are. Letters that occur in one
    alphabet only decide; a token of look-alikes only is a Roman numeral, the C of a degree sign, or open.
    """
    kinds = {(script_of(c), c in ALIKE) for c in token if c.isalpha()}
    scripts = {k for k, _ in kinds}
    if scripts <= {"C"}:
        if before == "°" and token == "С":
            return "C", False
        if len(token) > 1 and not set(token) - {"Х", "І"} and ROMAN.fullmatch(roman := token.translate(TO_LATIN)):
            return roman, False
        return token, False
    cyrillic, latin = ("C", False) in kinds, ("L", False) in kinds
    if "" in scripts:  # a letter of no known alphabet
        return (token.translate(TO_CYRILLIC) if cyrillic and not latin else token), cyrillic
    if cyrillic and latin and (plain := token.translate(STRESSED)) != token:
        return alphabet(plain, before, latin_beside)
    if cyrillic and not latin:
        return token.translate(TO_CYRILLIC), False
    if latin and not cyrillic:
        return (token if scripts == {"L"} else token.translate(TO_LATIN)), False
    if latin and cyrillic:
        return token, True
    roman = token.translate(TO_LATIN)
    if before == "°" and roman == "C" or len(roman) > 1 and not set(roman) - set("IXCM") and ROMAN.fullmatch(roman):
        return roman, False
    if latin_beside:
        return roman, False
    return token.translate(TO_CYRILLIC), True


def _settled(text: str) -> bool:
    return bool(PLAIN.fullmatch(text)) and not ROMANLIKE.search(text)


def _beside_latin(text: str, found: list[re.Match], k: int) -> bool:
    """Whether a hyphen joins the k-th token to one with a letter that only the Latin alphabet has."""
    before = k > 0 and text[found[k - 1].end() : found[k].start()] == "-" and LATIN_ONLY.search(found[k - 1].group())
    after = k + 1 < len(found) and text[found[k].end() : found[k + 1].start()] == "-" and LATIN_ONLY.search(found[k + 1].group())
    return bool(before or after)


def usual_form(text: str | None, spelling: dict[str, str] | None = None) -> str | None:
    """The value as it is usually written. spelling: canonical spellings of odd words, which go before the table."""
    if not text or _settled(text):
        return text
    text = shaped(text)
    if _settled(text):
        return text
    out, at = [], 0
    found = list(TOKEN.finditer(text))
    latin_text = bool(LATIN_ONLY.search(text)) and not CYRILLIC_ONLY.search(text)
    for k, m in enumerate(found):
        token, start = m.group(), m.start()
        if ONLY_CYRILLIC.search(token) and PLAIN.fullmatch(token):
            continue
        beside = latin_text or _beside_latin(text, found, k)
        fixed, unsure = alphabet(token, "°" if start and text[start - 1] == "°" else "", beside)
        if spelling and (unsure or fixed != token and not beside):
            fixed = spelling.get(token, fixed)
        if fixed != token:
            out += [text[at:start], fixed]
            at = m.end()
    if out:
        text = APOSTROPHE.sub("'", composed("".join([*out, text[at:]])))
    return accented(text)


def words(text: str | None) -> list[str]:
    """The words of a text as a reader sees them, ignoring case; a stress mark is no part of a word."""
    if not text:
        return []
    text = usual_form(text)
    if "\u0301" in text:
        text = text.replace("\u0301", "")
    return WORD.findall(text.lower())


def code(word: str) -> int:
    """64 bits of a word, alike on every machine."""
    return xxhash.xxh3_64_intdigest(word)
