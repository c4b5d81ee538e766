"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Labels mark documents, the field needs marked tokens: a token of a toxic document is marked
when its word, or a beginning of it, occurs far more often in toxic documents. The field
is trained on these sequences; forward-backward marginals of every token of a document are
summed up, and a logistic curve fitted to the document labels turns that into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _MASKS, ALNUM, Words, _quoted, eights, lean, materialise, mix, release, replaced, slices

#: At most so many labelled rows, of so many code points together, train the model.
TRAIN_ROWS, TRAIN_CHARS = 6000, 10_000_000
#: Beginnings of words, in bytes, that are features beside the word itself.
PREFIXES = (5, 6, 7, 8)
TABLE_BITS = 18
CHUNK = 64
THRESHOLD = 0.3
USUAL_WORDS = 200
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def features(words: Words) -> np.ndarray:
    """Slots of each word's features in the table of weights: (words, 1 + prefixes)."""
    mask = np.uint64((1 << TABLE_BITS) - 1)
    first, sizes = eights(words.data)[words.starts], words.ends - words.starts
    out = np.empty((len(words.hash), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = mix(words.hash) & mask
    for k, n in enumerate(PREFIXES):
        head = first & np.uint64((1 << 8 * n) - 1) & _MASKS[np.minimum(sizes, 8)]
        out[:, k + 1] = mix((head + np.uint64(1)) * np.uint64(2 * n + 1)) & mask
    return out


class Chains:
    """Sequences laid out in chunks, so that each step of a pass works on all chunks at once."""

    def __init__(self, first: np.ndarray):
        sizes = np.diff(first)
        self.n = int(first[-1])
        self.chunks = -(-sizes // CHUNK)
        begin = np.concatenate([[0], np.cumsum(self.chunks)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(self.n) - np.repeat(first[:-1], sizes)
        self.slot = (begin[doc] + within // CHUNK) * CHUNK + within % CHUNK
        self.total = int(begin[-1])
        self.order = np.argsort(-self.chunks, kind="stable")
        self.begin = begin[:-1]
        self.filled = np.zeros(self.total * CHUNK, bool)
        self.filled[self.slot] = True
        self.filled = self.filled.reshape(self.total, CHUNK)

    def marginals(self, score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of state 1 at each token; expected counts of transitions."""
        odds = np.zeros(self.total * CHUNK)
        odds[self.slot] = score
        odds = np.exp(np.clip(odds, -30, 30)).reshape(self.total, CHUNK)
        step = np.exp(trans)
        inside = self.filled
        product = np.zeros((self.total, 2, 2))
        product[:, 0, 0] = product[:, 1, 1] = 1
        for t in range(CHUNK):
            new = product @ step
            new[:, :, 1] *= odds[:, t, None]
            new /= new.sum((1, 2), keepdims=True)
            product = np.where(inside[:, t, None, None], new, product)
        # from the start of each sequence to the start of each chunk, and from its end back
        ahead, behind = np.empty((self.total, 2)), np.empty((self.total, 2))
        most = int(self.chunks.max(initial=0))
        counts = self.chunks[self.order]
        state = np.tile([1.0, 0.0], (len(counts), 1))
        for c in range(most):
            live = int(np.searchsorted(-counts, -c, "left"))
            at = self.begin[self.order[:live]] + c
            ahead[at] = state[:live]
            moved = np.einsum("ki,kij->kj", state[:live], product[at])
            state[:live] = moved / moved.sum(1, keepdims=True)
        state = np.ones((len(counts), 2))
        for c in range(most - 1, -1, -1):
            live = int(np.searchsorted(-counts, -c, "left"))
            at = self.begin[self.order[:live]] + c
            behind[at] = state[:live]
            moved = np.einsum("kij,kj->ki", product[at], state[:live])
            state[:live] = moved / moved.sum(1, keepdims=True)
        later = np.empty((self.total, CHUNK, 2))
        state = behind
        for t in range(CHUNK - 1, -1, -1):
            later[:, t] = state
            weighted = state.copy()
            weighted[:, 1] *= odds[:, t]
            moved = weighted @ step.T
            moved /= moved.sum(1, keepdims=True)
            state = np.where(inside[:, t, None], moved, state)
        out, pairs, state = np.empty((self.total, CHUNK)), np.zeros((2, 2)), ahead
        for t in range(CHUNK):
            joint = state[:, :, None] * step * later[:, t, None, :]
            joint[:, :, 1] *= odds[:, t, None]
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += joint[inside[:, t]].sum(0)
            out[:, t] = joint[:, :, 1].sum(1)
            moved = state @ step
            moved[:, 1] *= odds[:, t]
            moved /= moved.sum(1, keepdims=True)
            state = np.where(inside[:, t, None], moved, state)
        return out.reshape(-1)[self.slot], pairs


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the document score is made of: expected toxic tokens, their share, the surest one, the length against a usual one.

    A text without words counts as one of usual length, so its score is that of texts without any sign.
    """
    total = np.concatenate([[0], np.cumsum(p)])
    n = np.diff(first).astype(float)
    s = total[first[1:]] - total[first[:-1]]
    most = np.zeros(len(n))
    if len(p):
        some = n > 0
        most[some] = np.maximum.reduceat(p, first[:-1][some])
    share = s / np.maximum(n, 1)
    size = np.where(n > 0, np.log1p(n) - np.log1p(USUAL_WORDS), 0)
    return np.stack([np.ones_like(n), np.log1p(s), most, np.sqrt(share), np.log1p(s) ** 2 / 4, size / 8], axis=1)


class Model:
    """Weights of the field and of the document score."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, curve: np.ndarray):
        self.weights, self.bias, self.trans, self.curve = weights, bias, trans, curve

    def tag(self, words: Words) -> np.ndarray:
        return self.tag_slots(features(words), words.first)

    def tag_slots(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(slots):
            return np.zeros(0)
        score = self.weights[slots].sum(1, dtype=np.float64) + self.bias
        return Chains(first).marginals(score, self.trans)[0]

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(p, first) @ self.curve, -30, 30)))


def _distinct(words: Words, seen: set[bytes]) -> np.ndarray:
    """One document of each kind of near copies: those whose two smallest 3-gram hashes agree."""
    hashes, at = words.grams(3)
    owner = words.doc[at]
    keep = []
    edges = np.searchsorted(owner, np.arange(words.n_docs + 1))
    for k in range(words.n_docs):
        own = np.unique(hashes[edges[k] : edges[k + 1]])[:2]
        key = own.tobytes() if len(own) else words.hash[words.first[k] : words.first[k + 1]].tobytes()
        if key not in seen:
            seen.add(key)
            keep.append(k)
    return np.array(keep, np.int64)


def _runs(n: int, size: int) -> list[tuple[int, int]]:
    return [(k, min(n, k + size)) for k in range(0, n, size)]


def mark(slots: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic documents with a feature that is far more frequent there."""
    n = len(toxic)
    share = max(toxic.sum(), 1) / max(n - toxic.sum(), 1)
    marked = np.zeros(len(doc), bool)
    for k in range(slots.shape[1]):
        seen = np.unique(slots[:, k].astype(np.int64) * n + doc)
        bad, every = np.bincount(seen // n, toxic[seen % n], 1 << TABLE_BITS), np.bincount(seen // n, minlength=1 << TABLE_BITS)
        rare = (bad + 0.5) / (every - bad + 0.5) / share
        marked |= ((bad >= 4) & (rare >= 12))[slots[:, k]]
    return marked & toxic[doc].astype(bool)


def train(texts: pa.Array, toxic: np.ndarray, epochs: int = 4, batch: int = 128) -> Model:
    """Fits the field by AdaGrad on the marked sequences, then the curve by Newton steps."""
    weights, bias, trans = np.zeros(1 << TABLE_BITS, np.float32), -4.0, np.zeros((2, 2))
    curve = np.array([-2.0, 0, 0, 0, 0, 0])
    seen: set[bytes] = set()
    kept, sizes, own, at = [], [], [], 0
    for piece in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
        words = Words(piece.column(0), ALNUM)
        keep = _distinct(words, seen)
        kept.append(keep + at)
        sizes.append(np.diff(words.first)[keep])
        own.append(features(words)[np.isin(words.doc, keep)])
        at += piece.num_rows
    toxic = toxic[np.concatenate(kept)] if kept else toxic
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(weights, bias, trans, curve)
    slots, sizes = np.concatenate(own), np.concatenate(sizes)
    own.clear()
    first = np.concatenate([[0], np.cumsum(sizes)])
    truth = mark(slots, np.repeat(np.arange(len(sizes)), sizes), toxic)
    squares, bias_sq, trans_sq = np.full(1 << TABLE_BITS, 1e-2), 1.0, np.ones((2, 2))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(toxic)), max(1, len(toxic) // batch)):
            part = part[sizes[part] > 0]
            if not len(part):
                continue
            tokens = np.concatenate([np.arange(first[d], first[d + 1]) for d in part])
            edges = np.concatenate([[0], np.cumsum(sizes[part])])
            own, y = slots[tokens], truth[tokens].astype(float)
            p, pairs = Chains(edges).marginals(weights[own].sum(1, dtype=np.float64) + bias, trans)
            gap = y - p
            grad = np.bincount(own.ravel(), np.repeat(gap, own.shape[1]), 1 << TABLE_BITS) - 1e-3 * weights
            before = np.concatenate([[0], y[:-1]])
            before[edges[:-1]] = 0
            actual = np.zeros((2, 2))
            np.add.at(actual, (before.astype(int), y.astype(int)), 1)
            squares += grad**2
            weights += (0.3 * grad / np.sqrt(squares)).astype(np.float32)
            bias_sq += gap.sum() ** 2
            bias += 0.3 * gap.sum() / bias_sq**0.5
            trans_sq += (actual - pairs) ** 2
            trans += 0.3 * (actual - pairs) / np.sqrt(trans_sq)
    model = Model(weights, bias, trans, curve)
    x = np.concatenate([summary(model.tag_slots(slots[first[a] : first[b]], first[a : b + 1] - first[a]), first[a : b + 1] - first[a]) for a, b in _runs(len(sizes), batch)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
        grad = x.T @ (toxic - p) - 0.05 * model.curve
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        model.curve = model.curve + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model from at most ``rows`` labelled rows, taken by hash of the id, whole texts of any length.

    Together they have at most ``chars`` code points; texts of over a 64th of that come last.
    Ids whose crc32 mod 4 is 2 are never used. Labels other than 0 and 1 and null texts
    train nothing; without both labels every score is the same.
    """
    picked = (
        labels.filter(~held_out(_quoted(id_col)) & _quoted(label_col).isin(0, 1))
        .select(_quoted(id_col).alias("id"), _quoted(label_col).cast("int").alias("label"))
        .dropDuplicates(["id"])
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    texts = docs.select(_quoted(id_col).alias("id"), _quoted(text_col).alias("text")).filter("text IS NOT NULL")
    sample = materialise(texts.join(F.broadcast(picked), "id").dropDuplicates(["id"]), "toxic-sample")
    before = Window.orderBy(F.col("n") > chars // 64, F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sample.select("id", F.length("text").alias("n")).withColumn("total", F.sum("n").over(before))  # ``rows`` rows at most
    kept = sample.join(F.broadcast(sizes.filter(F.col("total") <= chars).select("id")), "id")
    got = kept.orderBy("id").select("text", "label").toArrow()
    model = train(got["text"].combine_chunks(), got["label"].to_numpy().astype(np.int64))
    del got
    release()
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs with toxic_score, toxic_spans (start, end in code points, score).

    The whole text is tagged; a span is a run of neighbouring words with marginals of a half
    or more and carries the largest. Null and empty texts have no spans and the score of no
    words. Only the text is read, so equal texts get equal scores. An empty table gives an empty result; input columns with
    the names of the results are replaced.
    """
    docs = replaced(docs, ["toxic_score", "toxic_spans"])
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_spans", SPAN)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            words = Words(batch.column(batch.schema.names.index(text_col)), ALNUM)
            p = shared.value.tag(words)
            score = shared.value.score(p, words.first)
            spans: list[list] = [[] for _ in range(words.n_docs)]
            chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)]) if (p >= 0.5).any() else None
            last = None
            for k in np.flatnonzero(p >= 0.5):
                doc = words.doc[k]
                base = chars[words.offsets[doc]]
                end = int(chars[words.ends[k]] - base)
                if last == k - 1 and words.doc[last] == doc:
                    spans[doc][-1] |= {"end": end, "score": max(spans[doc][-1]["score"], float(p[k]))}
                else:
                    spans[doc].append({"start": int(chars[words.starts[k]] - base), "end": end, "score": float(p[k])})
                last = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(spans, kind)], schema.names)

    return docs.mapInArrow(lean(run), schema)
