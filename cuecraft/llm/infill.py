"""Fill-in-the-middle examples: whole texts cut in three at random places and put in another order.

Cuts are found as bytes, results are told in code points. A sparse index of the characters that
take more than one byte converts between the two: ASCII spans are plain arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import NOT_SPACE, SPACE, _quoted, buffers, lean, replaced, slices

#: The marks of prefix, suffix and middle, and the shares in hundredths.
MARKS = ("<P>", "<S>", "<M>")
RATE, SPM = 50, 80
ADDED = ["fim_units", "fim_form", "prefix_chars", "middle_chars", "fim_text"]


class Exceptions:
    """Where a buffer of UTF-8 holds characters of several bytes, and how many bytes too many so far.

    One entry for each such character and none for ASCII: a buffer of ASCII has an empty index.
    """

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)  # first bytes
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.total = np.concatenate([np.zeros(1, np.int64), np.cumsum(excess)])
        self.at_char = self.at - self.total[:-1]

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte, which must be the first of a character or the end."""
        return at - self.total[np.searchsorted(self.at, at)]

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """The byte at which each code point begins."""
        return at + self.total[np.searchsorted(self.at_char, at)]


def word_cuts(data: np.ndarray, offsets: np.ndarray, index: Exceptions) -> tuple[np.ndarray, callable]:
    """Units are words with the white space before them, and what white space is left at the end."""
    inside = NOT_SPACE[data]
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    first = np.searchsorted(ends, offsets, "right")  # an end belongs to the text it closes
    words = np.diff(first)
    full = offsets[1:] > offsets[:-1]
    open_end = np.zeros(len(words), bool)
    open_end[full] = SPACE[data[offsets[1:][full] - 1]]

    def place(k: np.ndarray) -> np.ndarray:
        at = np.where(k > words, offsets[1:], offsets[:-1])
        own = (k > 0) & (k <= words)
        at[own] = ends[first[:-1][own] + k[own] - 1]
        return at

    return words + open_end, place


def char_cuts(data: np.ndarray, offsets: np.ndarray, index: Exceptions) -> tuple[np.ndarray, callable]:
    """Units are code points."""
    begin = index.chars(offsets)
    return np.diff(begin), lambda k: index.bytes(begin[:-1] + k)


CUTS = {"word": word_cuts, "char": char_cuts}


def draws(id_col: Column, seed: int) -> Column:
    """Four numbers below 2**32 from the id alone: the same in every run, whatever the partitions."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    rate: int = RATE,
    spm: int = SPM,
    unit: str = "word",
    keep_text: bool = True,
) -> DataFrame:
    """All input columns with fim_units, fim_form, prefix_chars, middle_chars and fim_text.

    A text of n units is cut after two of 0 to n, drawn from seed and id. fim_form is ``plain``
    (the text itself), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each
    part behind its mark. ``rate`` of a hundred texts change, ``spm`` of a hundred of those to spm.

    One pass over batches without a shuffle: what a row becomes depends on that row alone, so a lost
    task is just run again. Null texts count as empty; empty ones and those that hold a mark are
    plain, with null prefix_chars and middle_chars. A null id draws like an empty string, repeated
    rows draw alike. An empty table gives an empty result. Input columns with names of results are
    replaced, others pass through; without ``keep_text`` the text is left out.
    """
    docs = replaced(docs, ADDED)
    names = [n for n in docs.columns if keep_text or n.lower() != text_col.lower()]
    rows = docs.select(
        *[_quoted(n).alias(f"c{k}") for k, n in enumerate(names)],
        _quoted(text_col).cast("string").alias("__text"),
        draws(_quoted(id_col), seed).alias("__draws"),
    )
    cut, marks = CUTS[unit], [m.encode() for m in MARKS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, offsets = buffers(batch.column("__text"))
            index = Exceptions(data)
            units, place = cut(data, offsets, index)
            h = batch.column("__draws").flatten().to_numpy().reshape(-1, 4)
            a, b = h[:, 0] % (units + 1), h[:, 1] % (units + 1)
            low, high = place(np.minimum(a, b)), place(np.maximum(a, b))
            changed = (h[:, 2] % 100 < rate) & (offsets[1:] > offsets[:-1])
            first_suffix = h[:, 3] % 100 < spm
            raw, parts, forms = data.tobytes(), [], []
            for i, (x, p, m, y) in enumerate(zip(offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist(), strict=True)):
                if changed[i] and any(raw.find(mark, x, y) >= 0 for mark in marks):
                    changed[i] = False
                prefix, middle, suffix = (marks[0], raw[x:p]), (marks[2], raw[p:m]), (marks[1], raw[m:y])
                order = (raw[x:y],) if not changed[i] else suffix + prefix + middle if first_suffix[i] else prefix + suffix + middle
                parts.append(b"".join(order))
                forms.append("plain" if not changed[i] else "spm" if first_suffix[i] else "psm")
            chars = index.chars(np.stack([offsets[:-1], low, high]))
            out = [batch.column(k) for k in range(len(names))]
            out += [pa.array(units, pa.int64()), pa.array(forms, pa.string())]
            out += [pa.array(chars[k + 1] - chars[k], pa.int64(), mask=~changed) for k in (0, 1)]
            out.append(pa.array(parts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    types = [LongType(), StringType(), LongType(), LongType(), StringType()]
    schema = StructType([*[rows.schema[k] for k in range(len(names))], *map(StructField, ADDED, types)])
    made = rows.mapInArrow(lean(run), schema)
    return made.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], *ADDED)


def restored(text: Column, form: Column) -> Column:
    """The text that an output was made from, told by its form: parts lie between the first marks of each kind.

    No mark can begin in one part and end in the next, since a mark's first character is none of its others.
    """
    prefix, suffix, middle = map(F.lit, MARKS)
    width = len(MARKS[0])

    def between(begin: Column, end: Column | None) -> Column:
        at = F.instr(text, begin) + width
        return F.substring(text, at, (F.instr(text, end) if end is not None else F.length(text) + 1) - at)

    psm = F.concat(between(prefix, suffix), between(middle, None), between(suffix, middle))
    spm = F.concat(between(prefix, middle), between(middle, None), between(suffix, prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)
