"""Garbled text from wrong character encodings: found, and restored where possible.

For each way text gets garbled the characters are mapped back to the legacy
bytes they stand for; a byte-structure automaton (well-formed UTF-8 as a
compiled byte expression) finds the maximal multibyte spans, and only those
spans are decoded. Text garbled twice is decoded twice.

A single-byte encoding read as another leaves no multibyte structure, so the
automaton can't see it. For those pairs (old Macintosh and DOS code pages) the
words that no Latin-script language could spell are mapped back byte by byte.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

#: Text without any of these is never garbled and stays in the JVM: characters outside ASCII other than the letters and quotes
#: of Spanish, such a letter in lower case beside capitals (a DOS capital read as Latin-1), or a question mark between letters (a lost one).
SUSPECT = r"[^\x{0}-\x{7F}áéíóúüñÁÉÍÓÚÜÑ«»]|\p{Lu}[éà]\p{Lu}|\p{Ll}\?\p{Ll}"

#: Well-formed UTF-8 of two to four bytes, one or more in a row.
_WELL_FORMED = regex.compile(
    rb"(?:[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    rb"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})+"
)

def _page(codec: str) -> np.ndarray:
    """Byte by code point: ASCII stands for itself, C1 controls too where the codec leaves them out, any other character the page lacks is 0."""
    table = np.zeros(0x10000, np.uint8)
    table[:0x80] = np.arange(0x80)
    table[0x80:0xA0] = np.arange(0x80, 0xA0) if codec == "cp1252" else 0
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            table[b] = b
    return table


_PAGES = {codec: _page(codec) for codec in ("cp1252", "mac_roman", "cp437", "cp850")}

#: What a decoded span may hold: letters of Latin, Greek and Cyrillic, signs and punctuation in use, invisible characters and spaces,
#: and characters that a further round decodes.
_PLAUSIBLE = regex.compile(
    r"[\x80-ſƒˆ˜\u0300-\u0303\u0308\u0327Ͱ-ϿЀ-џ\u2000-\u206F€℀-⅏←-⋿─-◿\u3000\uFB00-\uFB06\uFEFF-\uFF5E\uFFFD]+"
)
#: A capital before a closing quote or an ordinal sign is ordinary Portuguese spelling, not a span.
_QUOTED_END = regex.compile(r"(?<=\p{Lu})[ÃÂ][»º]\Z")


def _spans(text: str, points: np.ndarray, page: str) -> list[tuple[int, int, str]]:
    """Start, end and decoded text of the maximal multibyte spans of `text` under `page`."""
    found = []
    for m in _WELL_FORMED.finditer(_PAGES[page][points].tobytes()):
        start, end = m.span()
        plain = m[0].decode("utf-8")
        if _PLAUSIBLE.fullmatch(plain):
            found.append((start, end, plain))
    return found if len(found) > 1 else [x for x in found if not _QUOTED_END.search(text, max(0, x[0] - 1), x[1])]


def _decode_spans(text: str) -> tuple[str, int]:
    """`text` with its multibyte spans decoded under the page that explains most of its characters, and the number of spans."""
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)
    if not (points > 0x7F).any():
        return text, 0
    best, most = [], 0
    for page in _PAGES:
        found = _spans(text, points, page)
        if (covered := sum(end - start for start, end, _ in found)) > most:
            best, most = found, covered
    parts, at = [], 0
    for start, end, plain in best:
        parts += [text[at:start], plain]
        at = end
    return "".join([*parts, text[at:]]) if best else text, len(best)


# Single-byte pages read as another single-byte page: the letters that the byte meant, by the character that was read.
_SPANISH = "áéíóúüñÁÉÍÓÚÜÑ"


def _misread(meant: str, read: str, wanted: str) -> dict[str, str]:
    table = {}
    for c in wanted:
        try:
            b = c.encode(meant)
        except UnicodeEncodeError:
            continue
        try:
            table[b.decode(read)] = c
        except UnicodeDecodeError:
            table[b.decode("latin-1")] = c
    return {k: v for k, v in table.items() if k != v}


_REST = "«»¿¡ºª°ãõâêôçàÃÕÂÊÔÇÀ"
_FROM_MAC = str.maketrans(_misread("cp1252", "mac_roman", _REST + _SPANISH))
_FROM_DOS = str.maketrans(_misread("cp850", "cp1252", _REST + _SPANISH))

#: Words that only a misread can give. Letters (capitals that Spanish lacks) must stand where no word has them; signs must touch a letter.
_MAC_SURE = regex.compile(
    r"\p{Ll}[·˙ÈÌÛÒ]|[·˙ÈÌÛÒ]\p{Ll}|\p{Lu}[”…⁄]\p{Lu}|\p{Lu}Õ(?![EÕ])|(?<!\p{L})Õ(?=[B-DF-Z])|\p{Lu}[ÀÃ]\p{Ll}{2}|\p{L}¸\p{L}"
)
_DOS_SURE = regex.compile(r"\p{L}[¢£¤‚¡]|(?<![\p{L}\p{N}])[¢£¤]\p{L}|\p{Lu}[µ¥\x90Öéà]\p{Lu}|\p{Lu}[µ¥]|[µ\x90]\p{Lu}|\p{L}\x81\p{L}")
#: A no-break space that was "á": beside a blank or sign, or between parts that can't be words.
_DOS_SPACE = regex.compile(
    r"\p{Ll}\xA0(?=[\s.,;:)»])|(?<=\s)\xA0\p{Ll}|[bcfghkmpqtvwxñ]\xA0\p{Ll}|(?<!\p{L})[^\W\daeiouáéíóúy]{1,3}\xA0\p{Ll}|\p{Ll}\xA0[^\W\daeouy](?!\p{L})"
)
#: Other blanks and invisible characters: where they stand, a no-break space proves nothing.
_BLANKS = regex.compile(r"[\u00AD\u2000-\u200F\u202F\u205F-\u2064\u3000\uFEFF]")
#: Leads that the automaton left and that nothing but a wrong decoding writes, a lead at the very end, the replacement character, and control characters.
_STRAY = regex.compile(r"[\uFFFD\x80-\x84\x86-\x9F├┬╬╨╤╧╞╟╠]|\p{L}√|√\p{L}{2}|\p{Ll}[ÃÂ](?!\p{Ll})|\p{Ll}\?\p{Ll}|[â]€")

#: A lead that stands alone at the very end, where a garbled text was cut.
_CUT_OFF = regex.compile(r"(?<!\p{L})[ÃÂ]\Z")
#: Signs as a misread gives them, where they hug what the sign that was meant would hug. They count only between misread words.
_MAC_SIGNS = regex.compile(r"´(?=[\p{L}\p{N}])|(?<=[\p{L}\p{N}.,])ª(?![\p{L}\p{N}])|ø(?=\p{L})|°(?=\p{L})|(?<=\d)[∫™]|⁄(?=\p{Lu}{2})")
_DOS_SIGNS = regex.compile(
    r"[éàµ¥Ö\x90](?=\p{Lu}{2})|\x90(?=\p{Ll})|®(?=[\p{L}\p{N}])|(?<=[\p{L}\p{N}.,])¯|¨(?=\p{L})|\xAD(?=\p{Lu})|(?<=\d)[§¦]|(?<!\p{L})[‚¡](?=\p{Ll})|(?<=\p{Ll})\x81|\xA0(?=\p{Ll})|(?<=\p{Ll})\xA0"
)
#: Shapes that a word can have; a letter in any other place isn't one that was misread.
_WORD_SHAPE = regex.compile(r"\P{L}*(?!Ñ[^\WAEIOUaeiouáéíóú])(?:\p{Lu}?\p{Ll}{2,}|\p{Lu}\p{Ll}|\p{Lu}{2,})\P{L}*")
_BLANK = regex.compile(r"[ \n\t\r]")
_ODD_WORDS = regex.compile(r"[^ \n\t\r]*[^\x00-\x7F \n\t\r][^ \n\t\r]*")
_SIGN_INSIDE = regex.compile(r"\p{L}[^\p{L}\p{M}\p{N}\s\x00-\x7F’]+\p{L}")


def _map_back(text: str, table: dict[int, str], sure: list[tuple[int, int]], signs: regex.Pattern) -> tuple[str, int]:
    """`text` with its surely misread words mapped back; between the first and the last of them also signs that hug a word, and words with a sign inside.

    The number counts the words between that may be misread as well, but that nothing proves to be; they stay.
    """
    if not sure:
        return text, 0
    spans: list[tuple[int, int]] = []  # of the words that hold a sure place
    for first, last in sorted(sure):
        if spans and last <= spans[-1][1]:
            continue
        start = max(text.rfind(c, 0, first + 1) for c in " \n\t\r") + 1
        ends = [m.start() for m in (_BLANK.search(text, last),) if m]
        spans.append((max(start, spans[-1][1] if spans else 0), ends[0] if ends else len(text)))
    parts, at, doubtful = [], spans[0][0], 0
    for start, end in spans:
        between = text[at:start]
        if not between.isascii():
            words = []

            def meant(m: regex.Match, words: list = words) -> str:
                word, plain = m[0], m[0].translate(table)
                if plain == word or not _WORD_SHAPE.fullmatch(plain):
                    return word
                if _SIGN_INSIDE.search(word):  # no word as it stands
                    return plain
                words.append(word)
                return word

            between = signs.sub(lambda m: m[0].translate(table), _ODD_WORDS.sub(meant, between))
            doubtful += len(words)
        parts += [between, text[start:end].translate(table)]
        at = end
    return "".join([text[: spans[0][0]], *parts, text[at:]]), doubtful


def repair(text: str, prose: bool = True) -> tuple[str, int, bool]:
    """The text as it was meant, the number of garbled places, and whether all of them could be restored.

    Only in `prose` can a no-break space be a letter: between the words of names, spaces of all kinds stand for blanks.
    """
    places, plain = 0, text
    while True:  # text garbled several times over; each round makes it shorter
        plain, n = _decode_spans(plain)
        places += n
        if not n:
            break
    mac = [m.span() for m in _MAC_SURE.finditer(plain)]
    plain, open_mac = _map_back(plain, _FROM_MAC, mac, _MAC_SIGNS)
    dos = [m.span() for m in _DOS_SURE.finditer(plain)]
    if prose and "\xa0" in plain and not _BLANKS.search(plain):
        dos += [m.span() for m in _DOS_SPACE.finditer(plain)]
    plain, open_dos = _map_back(plain, _FROM_DOS, dos, _DOS_SIGNS)
    places += len(mac) + len(dos)
    left = sum(1 for _ in _STRAY.finditer(plain))
    cut_off = places > 0 and _CUT_OFF.search(plain) is not None
    return plain, places + left, left == 0 and not open_mac and not open_dos and not cut_off


@lru_cache(maxsize=4096)
def _repair_cached(text: str, prose: bool) -> tuple[str, int, bool]:
    return repair(text, prose)


_RESULT = T.StructType([T.StructField("restored", T.StringType()), T.StructField("garbled_places", T.IntegerType()), T.StructField("is_restored", T.BooleanType())])


def _repair_all(prose: bool):
    @arrow_udf(_RESULT)
    def run(values: pa.Array) -> pa.Array:
        out = [(None, 0, True) if t is None else repair(t, prose) if len(t) > 2000 else _repair_cached(t, prose) for t in values.to_pylist()]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.StructArray.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.bool_())], ["restored", "garbled_places", "is_restored"]
        )

    #: Not to be evaluated again where a filter on its result is moved below it.
    return run.asNondeterministic()


_REPAIRS = {prose: _repair_all(prose) for prose in (True, False)}


def repaired(column: Column, prose: bool = True) -> Column:
    """Struct (restored, garbled_places, is_restored) of a string column; names aren't `prose`.

    Null gives a null text with no place; text without a suspect character is
    returned as it is and never leaves the JVM.
    """
    untouched = F.struct(column.alias("restored"), F.lit(0).alias("garbled_places"), F.lit(True).alias("is_restored"))
    return F.when(column.rlike(SUSPECT), _REPAIRS[prose](F.when(column.rlike(SUSPECT), column))).otherwise(untouched)
