"""Visually identical text in one form: a longest-match transducer over grapheme clusters.

The mapping is precomputed from rules and short fixed lists and checked for
conflicts once, compositions included. One pass goes over the words that hold an input character, cluster by
cluster; what lies between them is copied. Text that holds none of the inputs (found by a JVM pattern) never
reaches Python.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from lexmill.llm.mojibake import repair

# Characters of other scripts that look like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ѵ": "v", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    # Greek
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian, Latin extensions
    "օ": "o", "ո": "n", "ս": "u", "ı": "i", "ɑ": "a", "ɡ": "g",
}
# Invisible characters, and spaces that are not U+0020.
INVISIBLE = "\u00AD\u034F\u061C\u180E\u200B\u200C\u200D\u200E\u200F\u2060\u2061\u2062\u2063\u2064\uFEFF"
SPACES = "\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"

#: Code point ranges whose compatibility form is plain Latin text: ligatures, full width forms, mathematical letters, Roman numeral signs.
COMPATIBLE = ((0xFB00, 0xFB06), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x2160, 0x217F))

#: Any character that the transducer may change, for the JVM.
SUSPECT = (
    r"[\u00A0\u00ADıɑɡ\u0300-\u036FͰ-ϿЀ-ԯ\u0530-֏\u061C\u1680\u180E\u1AB0-\u1AFF"
    r"\u2000-\u200F\u202F\u205F-\u2064Ⅰ-ⅿ\u3000\uFB00-\uFB06\uFEFF\uFF01-\uFF5E\x{1D400}-\x{1D7FF}]"
)


#: Blocks whose letters are composed of a base and marks: Latin, Greek and Cyrillic.
COMPOSED_BLOCKS = ((0x00C0, 0x052F), (0x1E00, 0x1FFF))


def single_rules() -> dict[str, str]:
    """Outputs of single characters, without the look-alikes, which depend on the word around them."""
    table = {c: "" for c in INVISIBLE} | {c: " " for c in SPACES}
    for low, high in COMPATIBLE:
        for c in map(chr, range(low, high + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and plain.isascii():
                if table.setdefault(c, plain) != plain:
                    raise ValueError(f"two outputs for U+{ord(c):04X}")
    return table


def composition_rules() -> dict[str, str]:
    """Composed letters by the sequences that stand for them: a base with its marks in any order that doesn't change what is seen."""
    table: dict[str, str] = {}
    for low, high in COMPOSED_BLOCKS:
        for c in map(chr, range(low, high + 1)):
            base, *marks = unicodedata.normalize("NFD", c)
            if marks and unicodedata.normalize("NFC", c) == c and all(unicodedata.combining(m) for m in marks):
                for order in permutations(marks):
                    if unicodedata.normalize("NFC", base + "".join(order)) == c:
                        table[base + "".join(order)] = c
    return table


def check_mapping(singles: dict[str, str], composed: dict[str, str] | None = None) -> None:
    """Raise if a second pass could change the text again: an output that holds an input, or that makes one with what follows it."""
    inputs = set("".join(singles))
    for source, target in singles.items():
        if bad := inputs & set(target):
            raise ValueError(f"{source!r} gives {target!r}, which holds the input {bad}")
    for source, target in (composed or {}).items():
        if target in inputs or target in composed:
            raise ValueError(f"{source!r} gives {target!r}, which is an input")
        if inputs & set(source):
            raise ValueError(f"{source!r} is composed, and holds an input")


class Transducer:
    """The mapping as a machine over grapheme clusters: what a cluster gives is worked out when it first comes, and is a look-up after that.

    A cluster has two outputs, of which its word takes one: as it stands, and with
    look-alikes as Latin letters. Within a cluster the longest sequence that composes wins.
    """

    def __init__(self, singles: dict[str, str], composed: dict[str, str], lookalikes: dict[str, str], kept: int = 100_000):
        check_mapping(singles | lookalikes, {k: v for k, v in composed.items() if not set(k) & set(lookalikes)})
        self._singles, self._alike = str.maketrans(singles), str.maketrans(lookalikes)
        self._composed, self._longest = composed, max(map(len, composed))
        self._outputs: dict[str, tuple[str, str, bool, bool]] = {}
        self._kept = kept

    def _compose(self, text: str) -> str:
        parts, at = [], 0
        while at < len(text):
            for n in range(min(self._longest, len(text) - at), 1, -1):
                if (one := self._composed.get(text[at : at + n])) is not None:
                    break
            else:
                n, one = 1, text[at]
            parts.append(one)
            at += n
        return "".join(parts)

    def _output(self, cluster: str) -> tuple[str, str, bool, bool]:
        plain = cluster.translate(self._singles)
        if not plain.isascii():
            apart = unicodedata.normalize("NFD", plain)
            # other scripts compose by the same rule, without a table of their own
            plain, alike = (unicodedata.normalize("NFC", self._compose(x)) for x in (apart, apart.translate(self._alike)))
        else:
            alike = plain
        out = plain, alike, _LATIN.search(plain) is not None, _OTHER.search(plain) is not None
        if len(self._outputs) < self._kept and len(cluster) < 9:
            self._outputs[cluster] = out
        return out

    def word(self, text: str) -> str:
        found = [self._outputs.get(c) or self._output(c) for c in _CLUSTER.findall(text)]
        alike = any(x[2] for x in found) and any(x[3] for x in found)
        return "".join([x[alike] for x in found])

    def __call__(self, text: str) -> str:
        parts, at = [], 0
        for m in _INPUT.finditer(text):
            start = m.start()
            if start < at:
                continue
            end = start + 1
            if _in_word(text[start]):
                while start > at and _in_word(text[start - 1]):
                    start -= 1
                while end < len(text) and _in_word(text[end]):
                    end += 1
            parts += [text[at:start], self.word(text[start:end])]
            at = end
        return "".join([*parts, text[at:]])


@lru_cache(maxsize=10_000)
def _in_word(c: str) -> bool:
    """Letters, what becomes letters, and what may stand inside a word."""
    return c.isalpha() or c in INVISIBLE or unicodedata.category(c)[0] == "M" or TABLE.get(c, "").isalpha()


_LATIN = regex.compile(r"\p{Latin}")
_OTHER = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}ıɑɡ]")
#: A grapheme cluster, with marks that an invisible character keeps from it.
_CLUSTER = regex.compile(rf"\X(?:[{INVISIBLE}]+\p{{M}}+)*")
_INPUT = regex.compile(SUSPECT.replace(r"\x{1D400}-\x{1D7FF}", "\U0001D400-\U0001D7FF"))
TABLE = single_rules()
unify = Transducer(TABLE, composition_rules(), LOOKALIKES)


def _texts(values: pa.Array) -> list[str | None]:
    return values.to_pylist()


@arrow_udf(T.StringType())
def _unify_all(values: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unify(t) for t in _texts(values)], pa.string())


def unified(column: Column) -> Column:
    """One form of a string column. Null stays null and empty stays empty; text without suspects stays in the JVM."""
    return F.when(column.rlike(SUSPECT), _unify_all(F.when(column.rlike(SUSPECT), column))).otherwise(column)


def _differing(prose: bool):
    @arrow_udf(T.BooleanType())
    def differs(values: pa.Array) -> pa.Array:
        texts = [None if t is None else repair(t, prose)[0] for t in values.to_pylist()]
        return pa.array([t is not None and unify(t) != t for t in texts], pa.bool_())

    return differs


def is_mixed(column: Column, prose: bool = True) -> Column:
    """Whether a string column holds characters that `unified` would change, other than through a wrong decoding; null gives false.

    For names rather than `prose`, a no-break space is never taken for a wrongly decoded letter.
    """
    return F.coalesce(F.when(column.rlike(SUSPECT), _differing(prose)(F.when(column.rlike(SUSPECT), column))), F.lit(False))
