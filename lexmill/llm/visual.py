"""The ordinary form of text: what a reader sees, written with ordinary characters.

`SUSPICIOUS` is an RE2 expression; a text that does not match it is ordinary as it stands. The scan for it runs over Arrow
batches: Java's regular expressions took five times the CPU for the same class. Only matching texts reach `ordinary`,
which resolves composition, compatibility letters, invisible characters, unusual spaces and borrowed letters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Any character that may need a second look: outside ASCII text, the Latin letters of the languages at hand and common signs.
SUSPICIOUS = (
    r"[^\x09\x0A\x0D\x20-\x7EçÇəƏğĞıİöÖşŞüÜäÄßâÂîÎûÛáÁàÀéÉèÈêÊóÓúÚñÑãÃåÅÐŸ"
    r"«»“”„‟‘’‚‹›–—…№·•§±²³°£¥€¶©®×÷¿¡]"
)

# Cyrillic and Greek letters that look like a Latin letter, and Latin letters that look like another one.
CYRILLIC_AS_LATIN = dict(zip("АВЕКМНОРСТУХІЅЈҺӘӨԚԜаеорсхуіѕјһәөԛԝ", "ABEKMHOPCTYXISJHƏÖQWaeopcxyisjhəöqw"))
CYRILLIC_AS_LATIN.pop("Ө"), CYRILLIC_AS_LATIN.pop("ө")
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικονρυϲϳ", "ABEZHIKMNOPTYXaikovpucj"))
# More look-alikes of Latin letters, read as such inside Latin words; the other way round they stand for none.
OTHER_AS_LATIN = dict(zip("ҪҫҮүԁԌոՕօՍսհցᎪᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ÇçYydGnOoUuhgAEHJKLMPSTVWZ"))
LATIN_AS_LATIN = dict(zip("ǝƎșȘțȚɑɡᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀᴛᴜᴠᴡʏᴢ", "əƏşŞţŢagabcdeghijklmnoprtuvwyz"))
LATIN_AS_CYRILLIC = {v: k for k, v in CYRILLIC_AS_LATIN.items()}
GREEK_AS_CYRILLIC = {k: LATIN_AS_CYRILLIC[v] for k, v in GREEK_AS_LATIN.items() if v in LATIN_AS_CYRILLIC}

_INVISIBLE = regex.compile(r"[\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F\p{Cf}͏ᅟᅠㅤ︀-️\U000E0100-\U000E01EF]")
_SPACE = regex.compile(r"[\p{Zs}  \x85\x0B\x0C--[ ]]", regex.V1)
_TOKEN = regex.compile(r"[^ \t\r\n]+")
_RUN = regex.compile(r"[\p{L}\p{M}]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_SUSPICIOUS = regex.compile(SUSPICIOUS)
_STOP = regex.compile(r"[.!?…\n]")
_BORROWED = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]")


def _table() -> dict[int, str]:
    """Compatibility letters and digits (full-width, ligatures, styled, presentation forms) to what they stand for."""
    ranges = [(0x02B0, 0x02B9), (0x02E0, 0x02E5), (0x1D2C, 0x1D6B), (0x2070, 0x209D), (0x2460, 0x24EA), (0x0132, 0x0180), (0x01C4, 0x01F4), (0x1D400, 0x1D800), (0x2100, 0x2190), (0xFB00, 0xFE00), (0xFE70, 0xFF00), (0xFF10, 0xFFDD), (0x1FBF0, 0x1FBFA)]
    table = {}
    for lo, hi in ranges:
        for code in range(lo, hi):
            c = chr(code)
            if unicodedata.category(c) in ("Lu", "Ll", "Lo", "Nd", "Nl") or 0xFF66 <= code <= 0xFF9F or code < 0x2500 and code != 0x2116 and unicodedata.category(c) in ("Lm", "No", "So") and unicodedata.decomposition(c):
                k = unicodedata.normalize("NFKC", c)
                if k != c and k.replace(" ", "").isalnum():
                    table[code] = k
    return table


COMPATIBLE = _table()
_COMPAT = regex.compile("[" + "".join(map(chr, COMPATIBLE)) + "]")
_WIDE_SIGN = regex.compile(r"[！-～￠-￦]")


def _invisible(m) -> str:
    """A joiner between Persian letters, or after the sign that joins Indic consonants, is spelling; all else goes."""
    c, s, i = m.group(), m.string, m.start()
    if c in "‌‍" and 0 < i < len(s) - 1:
        a, b = s[i - 1], s[i + 1]
        if "؀" <= a <= "ۿ" and "؀" <= b <= "ۿ" or "ऀ" <= a <= "෿" and unicodedata.category(a) == "Mn":
            return c
    return ""


@lru_cache(200_000)
def _kind(run: str) -> str:
    """L, C, G: the script of a run of letters; l, c: the script it was meant in, though some letters are borrowed; ?: only letters that exist alike in several; -: another script."""
    latin = cyrillic = greek = other = latin_own = cyrillic_own = greek_own = 0
    for c in run:
        if c < "ʰ" or "Ḁ" <= c < "ἀ":
            latin += 1
            latin_own += c not in LATIN_AS_CYRILLIC
        elif "Ѐ" <= c < "԰":
            cyrillic += 1
            cyrillic_own += c not in CYRILLIC_AS_LATIN and c not in OTHER_AS_LATIN
        elif "Ͱ" <= c < "Ѐ":
            greek += 1
            greek_own += c not in GREEK_AS_LATIN
        elif c in OTHER_AS_LATIN:
            other += 1
        elif unicodedata.category(c)[0] == "L":
            return "-"
    if not latin + cyrillic + greek:
        return "-"
    if latin and not cyrillic + greek + other:
        return "L"
    if cyrillic and not latin + greek + other:
        return "C" if cyrillic_own else "?"
    if greek and not latin + cyrillic:
        return "G" if greek_own else "?"
    if greek_own:
        return "-"
    if cyrillic_own > latin_own or cyrillic_own and cyrillic > latin:
        return "c"
    return "l" if latin else "?"


def _to_latin(run: str) -> str:
    """Look-alikes are mapped apart from their marks and composed last."""
    return unicodedata.normalize("NFC", "".join(CYRILLIC_AS_LATIN.get(c) or GREEK_AS_LATIN.get(c) or OTHER_AS_LATIN.get(c) or c for c in unicodedata.normalize("NFD", run)))


def _to_cyrillic(run: str) -> str:
    return unicodedata.normalize("NFC", "".join(LATIN_AS_CYRILLIC.get(c) or GREEK_AS_CYRILLIC.get(c) or c for c in unicodedata.normalize("NFD", run)))


def _unborrow(text: str) -> str:
    """Letters borrowed from another script, replaced run by run; a run of look-alikes only follows its neighbours."""
    runs = [(m.start(), m.end(), m.group()) for m in _RUN.finditer(text)]
    kinds = [_kind(r) for _, _, r in runs]
    known = [i for i, k in enumerate(kinds) if k in "LlCc"]
    out, at, seen = [], 0, 0
    for i, ((lo, hi, run), kind) in enumerate(zip(runs, kinds)):
        while seen < len(known) and known[seen] < i:
            seen += 1
        if kind == "?":
            left = known[seen - 1] if seen else None
            right = known[seen] if seen < len(known) else None
            sides = [kinds[j].upper() for j in (left, right) if j is not None]
            if len(set(sides)) == 1:
                kind = sides[0]
            elif sides:
                kind = sides[1] if _STOP.search(text, runs[left][1], lo) else sides[0]
            else:
                kind = "-"
            kind = {"L": "l", "C": "c"}.get(kind, "-")
        if kind in "lc":
            new = _to_latin(run) if kind == "l" else _to_cyrillic(run)
            if new != run:
                out += text[at:lo], new
                at = hi
    return "".join(out) + text[at:] if out else text


_LATIN = str.maketrans(LATIN_AS_LATIN)
_DOTTED = regex.compile(r"[iı]̇")


def ordinary(text: str | None) -> str | None:
    """The ordinary form of a text; None stays None, a text of ordinary characters stays as it is. Line breaks and tabs are kept."""
    if text is None or not _SUSPICIOUS.search(text):
        return text
    s = unicodedata.normalize("NFC", text) if not text.isascii() else text
    if _INVISIBLE.search(s):
        s = unicodedata.normalize("NFC", _INVISIBLE.sub(_invisible, s))
    s = _SPACE.sub(" ", s)
    if _COMPAT.search(s):
        s = unicodedata.normalize("NFC", s.translate(COMPATIBLE))
    if _WIDE_SIGN.search(s) and not _CJK.search(s):
        s = _WIDE_SIGN.sub(lambda m: unicodedata.normalize("NFKC", m.group()), s)
    s = _DOTTED.sub("i", s).translate(_LATIN)
    s = unicodedata.normalize("NFC", s)
    return _unborrow(s) if _BORROWED.search(s) else s


def changes(text: str) -> list[tuple[str, str]]:
    """Each token of `text` (a run without ordinary white space) that is not in ordinary form, with its mapped form."""
    s = ordinary(text)
    if s == text:
        return []
    surfaces = _TOKEN.findall(text)
    return [(a, b) for a, b in zip(surfaces, _align(surfaces, s)) if a != b]


def _align(surfaces: list[str], mapped: str) -> list[str]:
    """The mapped text cut where the surface tokens end: a token with unusual spaces inside maps to several words, an invisible one to none."""
    words, at, out = _TOKEN.findall(mapped), 0, []
    for s in surfaces:
        n = len(_SPACE.sub(" ", _INVISIBLE.sub(_invisible, s)).translate(COMPATIBLE).split())
        out.append(" ".join(words[at : at + n]))
        at += n
    return out


def ordinary_array(texts: pa.Array) -> list[str | None]:
    """The ordinary forms of an Arrow array of texts; RE2 tells the few that may change, at the speed of a scan."""
    values = texts.to_pylist()
    for i in np.flatnonzero(pc.match_substring_regex(texts, SUSPICIOUS).fill_null(False).to_numpy(zero_copy_only=False)):
        values[i] = ordinary(values[i])
    return values


_GAP = 0xF8FF  # a private code point, never a letter or digit: stands between texts and for a null


def _fold_table(words: bool) -> np.ndarray:
    """Code point to code point: Azerbaijani lower case, 0 for what is dropped; for words, diacritics folded and white space to a space."""
    table = np.zeros(0x110000, dtype=np.uint32)
    fold = str.maketrans("əıöüçşğ", "eioucsg") if words else {}
    for code in range(0x32400):  # beyond are no letters
        c = chr(code)
        kind = unicodedata.category(c)[0]
        if kind in "LMN":
            low = {"I": "ı", "İ": "i"}.get(c) or c.lower()
            table[code] = ord((low if len(low) == 1 else c).translate(fold))
        elif words and c.isspace():
            table[code] = 32
    table[_GAP] = _GAP
    return table


@lru_cache(2)
def _fold(words: bool) -> np.ndarray:
    return _fold_table(words)


def folded(values: list[str | None], words: bool) -> list[str]:
    """All texts folded at once, by a table over code points; a null gives an empty text."""
    if not values:
        return []
    gap = chr(_GAP)
    joined = gap.join([v.replace(gap, "") if v and gap in v else v or "" for v in values])
    codes = _fold(words)[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    codes = codes[codes != 0]
    if words:  # one space between words, none at the ends
        space = codes == 32
        edge = space | (codes == _GAP)
        drop = space.copy()
        drop[1:] &= edge[:-1]
        if len(codes):
            codes = codes[~drop]
            space = codes == 32
            last = np.append(codes[1:], _GAP) == _GAP
            codes = codes[~(space & last)]
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split(gap)


@F.arrow_udf(T.StringType())
def _ordinary_udf(v: pa.Array) -> pa.Array:
    return pa.array(ordinary_array(v), pa.string())


@F.arrow_udf(T.StringType())
def _words_udf(v: pa.Array) -> pa.Array:
    return pa.array(folded(ordinary_array(v), True), pa.string())


@F.arrow_udf(T.StringType())
def _letters_udf(v: pa.Array) -> pa.Array:
    return pa.array(folded(ordinary_array(v), False), pa.string())


def ordinary_column(text: Column) -> Column:
    """The ordinary form as a column; null stays null."""
    return _ordinary_udf(text)


def plain_letters(text: Column) -> Column:
    """Letters, marks and digits of the ordinary form in Azerbaijani lower case; diacritics are kept. A null gives an empty text."""
    return _letters_udf(text)


def plain_words(text: Column) -> Column:
    """Plain words joined by one space: ordinary form, lower case, no punctuation, Azerbaijani diacritics folded; tokens
    without letter or digit are gone. A null gives an empty text."""
    return _words_udf(text)
