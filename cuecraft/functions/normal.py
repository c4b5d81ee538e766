"""Compatibility decomposition (NFKD) of text to ASCII, as column functions over tables generated from the Unicode database."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that have no decomposition, as slugs spell them.
SPELLED = (("ß", "ss"), ("ẞ", "SS"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O"))


@functools.cache
def decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """The ASCII part of each character's NFKD: one character, or several. Characters without an ASCII part are in neither."""
    one, several = {}, {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        full = unicodedata.normalize("NFKD", c)
        if full != c and (ascii_ := full.encode("ascii", "ignore").decode()):
            (one if len(ascii_) == 1 else several)[c] = ascii_
    return one, several


def to_ascii(text: Column) -> Column:
    """Text in ASCII: decomposed by NFKD or spelled out, what is left of other characters dropped."""
    one, several = decomposed()
    s = text
    for letter, spelled in SPELLED:
        s = F.replace(s, F.lit(letter), F.lit(spelled))
    s = F.translate(s, "".join(one), "".join(one.values()))
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    each = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    spread = F.array_join(F.transform(each, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.regexp_replace(F.when(s.rlike(r"[^\x00-\x7F]"), spread).otherwise(s), r"[^\x00-\x7F]", "")
