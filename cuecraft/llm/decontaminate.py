"""Benchmark decontamination by winnowing.

Of every nine consecutive 5-word grams the one with the smallest hash is a fingerprint,
so any shared run of 13 words shares one. Documents and benchmark items meet on their
fingerprints; each meeting is extended word by word to its full length, and spans of 13
words or more count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, _quoted, bit_words, bitmap_of, chain, in_bitmap, lean, materialise, mix, replaced, slices, with_bit

#: Benchmarks of up to so many bytes of text are sent to every task; larger ones are joined.
BROADCAST_BYTES = 16 << 20


def winnow(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the word index where each begins, once per place."""
    hashes, at = words.grams(gram)
    span = window - gram + 1
    count = len(hashes) - span + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best, place = hashes[:count].copy(), np.arange(count)
    for j in range(1, span):
        later = hashes[j : j + count]
        lower = later <= best
        best[lower] = later[lower]
        place[lower] = np.flatnonzero(lower) + j
    whole = words.doc[at[:count]] == words.doc[at[span - 1 :]]
    place = np.unique(place[whole])
    return hashes[place], at[place]


class Index:
    """Fingerprints of the benchmark, sorted, with the words to extend hits against."""

    def __init__(self, ids: list, texts: pa.Array, window: int, gram: int):
        self.window, self.gram, self.ids = window, gram, ids
        words = Words(texts, ALNUM)
        self.hash, self.item = words.hash, words.doc
        prints, at = winnow(words, window, gram)
        order = np.argsort(prints, kind="stable")
        self.prints, self.at = prints[order], at[order]
        sizes = np.diff(words.first)
        self.short = {}
        for n in np.unique(sizes[(sizes > 0) & (sizes < window)]):
            owners = np.flatnonzero(sizes == n)
            whole, first = words.grams(int(n))
            keep = np.isin(first, words.first[:-1][owners])
            whole, owner = whole[keep], words.doc[first[keep]]
            order = np.argsort(whole, kind="stable")
            self.short[int(n)] = (whole[order], owner[order])

    @staticmethod
    def _meet(sorted_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (into hashes, into sorted_hashes) of equal values."""
        low, high = np.searchsorted(sorted_hashes, hashes, "left"), np.searchsorted(sorted_hashes, hashes, "right")
        n = high - low
        left = np.repeat(np.arange(len(hashes)), n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return left, right

    def match(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Rows (first word, end, document, item) of the hits, and the mask of words hit."""
        rows = []
        prints, at = winnow(words, self.window, self.gram)
        mine, theirs = self._meet(self.prints, prints)
        if len(mine):
            doc_at, item_at = at[mine], self.at[theirs]
            left = self._extend(words, doc_at, item_at, -1)
            right = self._extend(words, doc_at, item_at, 1)
            long = left + right + 1 >= self.window
            rows.append(np.stack([doc_at - left, doc_at + right + 1, words.doc[doc_at], self.item[item_at]])[:, long])
        for n, (hashes, owner) in self.short.items():
            grams, first = words.grams(n)
            mine, theirs = self._meet(hashes, grams)
            if len(mine):
                start = first[mine]
                rows.append(np.stack([start, start + n, words.doc[start], owner[theirs]]))
        found = np.unique(np.concatenate(rows, axis=1), axis=1) if rows else np.zeros((4, 0), np.int64)
        edges = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(edges, found[0], 1)
        np.add.at(edges, found[1], -1)
        return found, np.cumsum(edges[:-1]) > 0

    def _extend(self, words: Words, doc_at: np.ndarray, item_at: np.ndarray, step: int) -> np.ndarray:
        """How many words further, one way, both sides stay equal."""
        length = np.zeros(len(doc_at), np.int64)
        alive = np.arange(len(doc_at))
        while len(alive):
            length[alive] += 1
            a, b = doc_at[alive] + step * length[alive], item_at[alive] + step * length[alive]
            ok = (a >= 0) & (b >= 0) & (a < len(words.hash)) & (b < len(self.hash))
            alive, a, b = alive[ok], a[ok], b[ok]
            ok = (words.hash[a] == self.hash[b]) & (words.doc[a] == words.doc[doc_at[alive]]) & (self.item[b] == self.item[item_at[alive]])
            alive = alive[ok]
        return length - 1


def _columns(index_of, words: Words) -> tuple[list, list, list, list]:
    found, hit = index_of.match(words)
    n_words = np.diff(words.first)
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[words.first[1:]] - total[words.first[:-1]]
    spans: list[list] = [[] for _ in n_words]
    items: list[list] = [[] for _ in n_words]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for start, end in edge.reshape(-1, 2):
        while start < end:  # neighbouring documents are cut apart
            doc = words.doc[start]
            stop = min(end, words.first[doc + 1])
            spans[doc].append({"start": int(start - words.first[doc]), "end": int(stop - words.first[doc])})
            start = stop
    for doc, item in np.unique(found[2:], axis=1).T:
        items[doc].append(index_of.ids[item])
    return n_words, n_hit, spans, items


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = 13,
    gram: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All columns of docs with n_words, n_hit, hit_spans (word offsets) and hit_items.

    Words are ASCII letters and digits (A-Z as a-z) and all other characters. A window is
    ``window`` consecutive words of an item; a shorter item is one window as a whole.

    A benchmark whose texts are at most ``broadcast_bytes`` is sent to every task and the
    documents are read once, without a shuffle. A larger one is joined, with the same result.

    An item may have any id, null too. Null or empty texts have no words and no hits, items of no words match nothing, repeated
    items are all reported. Empty tables give empty results or no hits. Rows of docs with
    equal texts get equal results; input columns with the names of the results are replaced.
    """
    added = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
            T.StructField("hit_items", T.ArrayType(benchmark.schema[item_col].dataType)),
        ]
    )
    docs = replaced(docs, added.names)
    schema = T.StructType(docs.schema.fields + added.fields)
    items = benchmark.select(_quoted(item_col).alias("item"), F.coalesce(_quoted(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(docs, items, schema, text_col, window, gram)
    rows = items.toArrow()
    index = Index(rows["item"].to_pylist(), rows["text"], window, gram)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    types = _arrow_types(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            words = Words(batch.column(batch.schema.names.index(text_col)), ALNUM)
            arrays = [pa.array(x, t) for x, t in zip(_columns(shared.value, words), types, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns + arrays, batch.schema.names + added.names)

    return docs.mapInArrow(lean(run), schema)


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


#: Turns a word's hash into another, for the second half of a window's 128 bits.
_OTHER = np.uint64(0x5851F42D4C957F2D)


def _twice(words: Words, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the n words from each place on."""
    return chain(words.hash, at, n), chain(mix(words.hash ^ _OTHER), at, n)


def _around(words: Words, places: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Where the windows begin that hold the gram at one of the places and lie in its text."""
    starts = np.unique((places[:, None] - np.arange(window - gram + 1)[None]).ravel())
    starts = starts[(starts >= 0) & (starts + window <= len(words.hash))]
    return starts[words.doc[starts] == words.doc[starts + window - 1]]


def filter_bits(prints: int) -> int:
    """Bits of a filter for so many fingerprints, 2 to the power of: sixteen for each, 32 MB at most."""
    return min(28, max(12, (16 * prints).bit_length()))


def _joined(docs: DataFrame, items: DataFrame, schema: T.StructType, text_col: str, window: int, gram: int) -> DataFrame:
    """By fingerprint, then by window: the windows around a document's fingerprints that the benchmark may have meet its windows.

    Fingerprints of the benchmark screen documents as a filter whose size is bounded; windows, known by 128 bits, are joined
    with equal ones alone, so a frequent fingerprint makes no pairs. Texts of documents are read in place; those with
    hits, and no others, are dealt by their digest to meet their spans and items.
    """
    text = F.coalesce(_quoted(text_col), F.lit(""))
    keyed = docs.withColumn("__key", F.unhex(F.sha2(text, 256)))
    items = items.withColumn("ikey", F.unhex(F.sha2("text", 256)))
    own = materialise(items.select("ikey", "text").dropDuplicates(["ikey"]), "items")
    lengths = [r[0] for r in own.select("text").mapInArrow(lambda b: _short_lengths(b, window), "n int").distinct().collect()]  # fewer than ``window`` values

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(0), ALNUM)
            sizes = np.diff(words.first)
            found = [winnow(words, window, gram)[0]]
            for n in lengths:
                hashes, at = words.grams(n)
                found.append(hashes[sizes[words.doc[at]] == n])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["print"])

    known = materialise(own.select("text").mapInArrow(lean(prints), "print long").distinct(), "prints")
    bits = filter_bits(known.count())
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(known, "print", bits))

    def windows(key: str, screened: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = lambda hashes: in_bitmap(sent.value, (hashes & np.uint64((1 << bits) - 1)).astype(np.int64))
            for batch in slices(batches, "text"):
                words = Words(batch.column(batch.schema.names.index("text")), ALNUM)
                sizes, sets = np.diff(words.first), []
                if screened:
                    found, at = winnow(words, window, gram)
                    sets.append((_around(words, at[here(found)], window, gram), window))
                else:
                    sets.append((words.grams(window)[1], window))
                for n in lengths:
                    hashes, at = words.grams(n)
                    sets.append((at[here(hashes) if screened else sizes[words.doc[at]] == n], n))
                for at, n in sets:
                    first, second = _twice(words, at, n)
                    owner = batch.column(batch.schema.names.index(key)).take(pa.array(words.doc[at]))
                    place = pa.array((at - words.first[words.doc[at]]).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(np.full(len(at), n, np.int32)), owner, place], ["w1", "w2", "n", key, "at"])

        return lean(run), f"w1 long, w2 long, n int, {key} binary, at long"

    same = ["w1", "w2", "n"]
    of_items = materialise(own.mapInArrow(*windows("ikey", False)).select(*same, "ikey").distinct(), "item-windows")
    of_docs = keyed.select("__key", text.alias("text")).mapInArrow(*windows("__key", True)).distinct()
    hits = materialise(of_docs.join(of_items.select(*same).distinct(), same, "left_semi"), "hit-windows")
    spans = hits.groupBy("__key").agg(F.collect_set(F.struct("at", "n")).alias("__spans"))
    pairs = hits.select(*same, "__key").distinct().join(of_items, same).select("__key", "ikey").distinct()
    named = pairs.join(items.select("ikey", "item"), "ikey").groupBy("__key").agg(F.collect_list(F.struct("item")).alias("__items"))
    found = materialise(spans.join(named, "__key"), "decontaminate")

    extra = schema.fields[len(docs.columns) :]
    types = _arrow_types(T.StructType(extra))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            n_words = np.diff(Words(batch.column(batch.schema.names.index(text_col)), ALNUM).first)
            merged = []
            for places in batch.column(batch.num_columns - 2).to_pylist():
                runs: list[dict] = []
                for start, end in sorted((x["at"], x["at"] + x["n"]) for x in places or ()):
                    if runs and start <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], end)
                    else:
                        runs.append({"start": start, "end": end})
                merged.append(runs)
            n_hit = [sum(x["end"] - x["start"] for x in runs) for runs in merged]
            reported = [[x["item"] for x in those or ()] for those in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [pa.array(x, t) for x, t in zip((n_words, n_hit, merged, reported), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *arrays], [*batch.schema.names[:-2], *(f.name for f in extra)])

    hashed = F.xxhash64("__key")
    words = materialise(bit_words(found.select(hashed.alias("key")), "key", 24), "hit-bits")
    marked = with_bit(keyed.withColumn("__hash", hashed), "__hash", words, 24, "__may")
    rest = marked.filter("NOT __may").withColumns({n: F.lit(None).cast(found.schema[n].dataType) for n in ("__spans", "__items")})
    met = marked.filter("__may").join(found, "__key", "left")
    names = [*[_quoted(c) for c in docs.columns], "__spans", "__items"]
    return met.select(*names).unionByName(rest.select(*names)).mapInArrow(lean(finish), schema)


def _short_lengths(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sizes = np.unique(np.diff(Words(batch.column(batch.schema.names.index("text")), ALNUM).first))
        yield pa.RecordBatch.from_arrays([pa.array(sizes[(sizes > 0) & (sizes < window)].astype(np.int32))], ["n"])
