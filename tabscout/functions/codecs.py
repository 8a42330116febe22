"""Encodings: canonical names, detection and decoding of byte samples."""

from __future__ import annotations

import codecs
import encodings.aliases
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BOMS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def canonical_name(label: str | None) -> str | None:
    """Python's name of a codec; None if there is none."""
    try:
        return codecs.lookup(label).name if label else None
    except (LookupError, ValueError):
        return None


@lru_cache(maxsize=1)
def _known() -> dict[str, str]:
    """Normalised labels (lower case, - and blanks as _) and the canonical name of each."""
    names = {a for pair in encodings.aliases.aliases.items() for a in pair} | {"utf_8_sig"}
    found = {n.lower().replace("-", "_").replace(" ", "_"): canonical_name(n) for n in names}
    return {k: v for k, v in sorted(found.items()) if v}


@lru_cache(maxsize=1)
def _known_json() -> str:
    return json.dumps(_known())


def canonical(label: Column) -> Column:
    """The canonical name as an expression: a map that the driver builds once. Unknown: null."""
    table = F.from_json(F.lit(_known_json()), "map<string,string>")  # folded to a constant by the optimiser
    return F.try_element_at(table, F.regexp_replace(F.lower(label), "[- ]", "_"))


def unit_size(label: Column) -> Column:
    """Bytes of a code unit: 2 of UTF-16, 4 of UTF-32, else 1."""
    name = F.coalesce(canonical(label), F.lit(""))
    return F.when(name.startswith("utf-16"), 2).when(name.startswith("utf-32"), 4).otherwise(1)


def tail_label(head: Column, label: Column) -> Column:
    """The codec of a tail, which has no byte order mark: the head's mark gives the order."""
    name, mark = F.coalesce(canonical(label), F.lit("")), F.hex(F.substring(head, 1, 4))
    utf16 = F.when(mark.startswith("FEFF"), "utf-16-be").otherwise("utf-16-le")
    utf32 = F.when(mark == "0000FEFF", "utf-32-be").otherwise("utf-32-le")
    return F.when(name == "utf-8-sig", "utf-8").when(name == "utf-16", utf16).when(name == "utf-32", utf32).otherwise(label)


def python_tail_label(head: bytes, label: str | None) -> str | None:
    """The same in Python."""
    order = {"utf-8-sig": "utf-8", "utf-16": "utf-16-be" if head[:2] == codecs.BOM_UTF16_BE else "utf-16-le", "utf-32": "utf-32-be" if head[:4] == codecs.BOM_UTF32_BE else "utf-32-le"}
    return order.get(canonical_name(label) or "", label)


def tail_window(uncovered: Column, most: Column, unit: Column) -> Column:
    """Bytes of a tail window: at most `most`, never over the head, whole code units."""
    w = F.least(most, uncovered)
    return F.greatest(w - w % unit, F.lit(0))


def is_utf8_suffix(data: bytes) -> bool:
    """Is it UTF-8, but for a character cut at its start?"""
    n = 0
    while n < min(3, len(data)) and data[n] >> 6 == 2:
        n += 1
    try:
        data[n:].decode()
    except UnicodeDecodeError:
        return False
    return True


def utf8_suffix(data: Column) -> Column:
    """The same as an expression: the continuation bytes at the start skipped, at most three."""
    skip = F.length(F.regexp_extract(F.hex(F.substring(data, 1, 3)), "^(?:[89AB][0-9A-F])*", 0)) / 2
    return F.is_valid_utf8(F.substring(data, (skip + 1).cast("int"), F.length(data)).cast("string"))


def _share(text: str, *ranges: tuple[int, int]) -> float:
    """Share of the characters that are not ASCII in these ranges of code points."""
    own = [ord(c) for c in text if ord(c) > 0x7F]
    return sum(any(a <= c <= b for a, b in ranges) for c in own) / max(len(own), 1)


_KANA, _JAPANESE = (0x3040, 0x30FF), ((0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xFF01, 0xFF60))


def _japanese(text: str, data: bytes) -> bool:
    return _share(text, _KANA) >= 0.2 and _share(text, *_JAPANESE) >= 0.9


def _korean(text: str, data: bytes) -> bool:
    return _share(text, (0xAC00, 0xD7A3)) >= 0.85


def _leads(low: int, high: int):
    """Do the characters' first bytes lie in the rows of punctuation and of the commonest characters?"""

    def test(text: str, data: bytes) -> bool:
        pairs, at = [], 0
        while at < len(data) - 1:
            if data[at] > 0x7F:
                pairs.append(data[at])
                at += 1
            at += 1
        return sum(0xA1 <= x <= 0xA3 or low <= x <= high for x in pairs) >= 0.85 * max(len(pairs), 1)

    return test


#: Codecs of two bytes a character, and whether what they decode reads like their language, in the order in which they are asked.
_DOUBLE = (("euc_jp", _japanese), ("cp932", _japanese), ("euc_kr", _korean), ("gb18030", _leads(0xB0, 0xD7)), ("big5", _leads(0xA4, 0xC6)))


def _cyrillic(data: bytes) -> str | None:
    """cp1251 or koi8-r, by which of them makes most letters lower case; None if neither makes mostly letters."""
    high = [b for b in data if b > 0x7F]
    upper, lower = sum(0xC0 <= b <= 0xDF for b in high), sum(0xE0 <= b for b in high)
    if upper + lower < 0.9 * len(high):
        return None
    return "koi8-r" if upper > lower else "cp1251"


#: Letters beyond ASCII, in cp1252, of French, German, Spanish, Portuguese, Italian, the Nordic languages and Icelandic.
_WESTERN = tuple(frozenset((x + x.upper()).encode("cp1252")) for x in ("àâæçèéêëîïôùûüÿœ", "äöüß", "áéíóúüñ", "àáâãçéêíóôõú", "àèéìíîòóùú", "åäæéöø", "áæéíðóöúýþ"))


def _western(words: set[bytes]) -> bool:
    """Are over three quarters of these words, by their letters, such as one Western language could spell? Each counts once, however often it stands in the text."""
    spelt = sum(len(w) for w in words if any(a.issuperset(w) for a in _WESTERN))
    return spelt * 4 > sum(map(len, words)) * 3


def _eight_bit(data: bytes) -> str:
    """A codec for bytes that are no UTF-8. Latin letters beyond ASCII stand alone or in pairs among others; those of other scripts follow each other, and no one Western language has them all."""
    runs = re.findall(rb"[\x80-\xFF]+", data)
    longer = [x for x in runs if len(x) > 2]
    high, joined = sum(map(len, runs)), 0 if _western(set(longer)) else sum(map(len, longer))
    for label, reads in _DOUBLE if joined * 2 > high or data.count(0x82) + data.count(0x83) > len(data) // 8 else ():
        try:
            text = codecs.getincrementaldecoder(label)().decode(data, final=False)
        except UnicodeDecodeError:
            continue
        if reads(text, data):
            return label
    if joined * 4 > high * 3 and high >= 8 and (found := _cyrillic(data)):
        return found
    try:
        data.decode("cp1252")
        return "cp1252"
    except UnicodeDecodeError:
        return "latin-1"


def detect(data: bytes, ended: bool = False) -> str:
    """A label for a sample: its byte order mark, UTF-16 by its null bytes, UTF-8 (also if cut at its end, but where the source ended and all else is ASCII), else a codec of Japanese, Korean, Chinese or Cyrillic text or of Latin letters."""
    for mark, label in BOMS:
        if data.startswith(mark):
            return label
    if len(data) >= 4 and data[1::2].count(0) * 2 > len(data) // 2:
        return "utf-16-le"
    if len(data) >= 4 and data[0::2].count(0) * 2 > len(data) // 2:
        return "utf-16-be"
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(data, final=False)
    except UnicodeDecodeError:
        return _eight_bit(data)
    return _eight_bit(data) if ended and text.isascii() and len(text) < len(data) else "utf-8"


def decode(data: bytes, label: str | None) -> str:
    """The text, U+FFFD for what can't be decoded; an unknown codec reads as UTF-8."""
    try:
        return data.decode(label or "utf-8", errors="replace")
    except LookupError:
        return data.decode("utf-8", errors="replace")


@F.arrow_udf(StringType())
def detected(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else detect(x) for x in data.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def decoded(data: pa.Array, label: pa.Array) -> pa.Array:
    return pa.array([None if x is None else decode(x, e) for x, e in zip(data.to_pylist(), label.to_pylist())], pa.string())


READ = StructType([StructField(k, StringType()) for k in ("encoding", "head_text", "tail_text")])


def read_windows(head: bytes | None, tail: bytes | None, full: bool) -> tuple[str | None, str | None, str | None]:
    """Encoding, head and tail as text. The tail (of a full head) is cut at its start to whole code units, and makes the encoding be detected anew where it is no UTF-8."""
    if head is None:
        return None, None, None
    guess = detect(head)
    own = tail or b"" if full else b""
    unit = {"utf-16": 2, "utf-32": 4}.get((canonical_name(guess) or "")[:6], 1)
    own = own[len(own) % unit :]
    label = detect(head + own, ended=True) if own and canonical_name(guess) == "utf-8" and not is_utf8_suffix(own) else guess
    return label, decode(head, label), decode(own, python_tail_label(head, label)) if own else None


@F.arrow_udf(READ)
def read(head: pa.Array, tail: pa.Array, full: pa.Array) -> pa.Array:
    """struct<encoding,head_text,tail_text> of the windows: read_windows()."""
    rows = [dict(zip(("encoding", "head_text", "tail_text"), read_windows(*x))) for x in zip(head.to_pylist(), tail.to_pylist(), full.to_pylist())]
    return pa.array(rows, pa.struct([(k, pa.string()) for k in ("encoding", "head_text", "tail_text")]))


def matches_label(expected: Column, actual: Column) -> Column:
    """Does an expected encoding, as "latin-1 or cp1252 (not utf-8)", name the actual one?"""
    name = lambda x: F.coalesce(canonical(F.btrim(x)), F.lower(F.btrim(x)))
    alternatives = F.filter(F.split(F.regexp_replace(expected, r"\([^)]*\)", ""), " or "), lambda a: F.btrim(a) != "")
    own = name(actual)
    return F.exists(alternatives, lambda a: name(a) == own)


#: Not to be inlined (see functions.fields).
detected = detected.asNondeterministic()
decoded = decoded.asNondeterministic()
read = read.asNondeterministic()
