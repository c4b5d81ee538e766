"""Log-likelihood of whole documents under a gated recurrent network, and under unigrams.

The output is factored by class: p(word) = p(class | state) * p(word | class, state). The
most frequent words fill classes of their own with a softmax inside; all others, unseen
ones too, belong to a class by their last two bytes, inside which the unigram counts of the
whole corpus decide. The network is trained in numpy by truncated backpropagation, by many
tasks on their own documents whose weights are averaged after each round; each training
document is learnt from in one of the rounds. The state is carried over window after window
to the end of a document.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _quoted, lean, materialise, shuffle_width, slices

HIDDEN = 16
CLASSES, WORDS = 48, 48  # classes of frequent words, words in each
ENDINGS = 32  # classes of other words
#: Words whose counts are sent to every task; those of the rest are joined.
TABLE = 1 << 18
#: Tokens of one trainer in one round; the number of trainers grows with the corpus.
SHARD_TOKENS = 3 << 19
ROUNDS = 4
#: Tokens that a task holds before it sums up, trains or scores.
HELD = 3 << 19
#: Steps times lanes that a trainer lays out at most, unless one document is longer.
CELLS = 1 << 24
END = np.uint64(0x454E44)
END_CODE = 0
#: Bits of a hash behind its beginning, of which a table tells the place.
SHIFT = np.uint64(44)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending code, first): words of each text, then one end."""
    words = Words(column)
    sizes = np.diff(words.first)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = np.arange(len(words.hash)) + words.doc
    hashes, code = np.full(first[-1], END, np.uint64), np.full(first[-1], END_CODE, np.int32)
    hashes[at] = words.hash
    before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0) if len(at) else np.zeros(0, np.uint8)
    code[at] = before.astype(np.int32) * 256 + words.data[words.ends - 1]
    return hashes, code, first


class Vocabulary:
    """Counts of frequent words, their place in the network, and the mass of the other classes."""

    def __init__(self, top: pa.Table, endings: pa.Table):
        hashes, counts = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
        code = top["code"].to_numpy()
        self.n_model = min(len(hashes), CLASSES * WORDS)
        place = np.full(len(hashes), -1, np.int32)
        place[: self.n_model] = np.arange(self.n_model)
        at = np.argsort(hashes)
        self.hashes, self.counts, self.place = hashes[at], counts[at], place[at]
        # where the hashes of each beginning lie: most are found at the first of them
        self.start = np.searchsorted(self.hashes >> SHIFT, np.arange(1 << 64 - int(SHIFT), dtype=np.uint64)).astype(np.int32)
        mass, types = np.zeros(1 << 16), np.zeros(1 << 16)
        mass[endings["code"].to_numpy()] = endings["n"].to_numpy()
        types[endings["code"].to_numpy()] = endings["words"].to_numpy()
        self.total, self.types = int(mass.sum()), int(types.sum())
        np.subtract.at(mass, code[: self.n_model], counts[: self.n_model])
        np.subtract.at(types, code[: self.n_model], 1)
        common = np.argsort(-mass, kind="stable")[: ENDINGS - 1]
        self.ending = np.full(1 << 16, ENDINGS - 1, np.int32)
        self.ending[common] = np.arange(len(common))
        self.mass = np.bincount(self.ending, mass + 0.5 * types, ENDINGS) + 0.5
        self.unigram = np.concatenate([counts[: self.n_model] + 0.5, np.zeros(CLASSES * WORDS - self.n_model)])

    def look_up(self, hashes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not in the table) and symbol of each token: a word's place, or behind them its ending."""
        symbol = CLASSES * WORDS + self.ending[code]
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64), symbol
        at = np.minimum(self.start[hashes >> SHIFT], len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        rest = np.flatnonzero(self.hashes[at] < hashes)
        at[rest] = np.minimum(np.searchsorted(self.hashes, hashes[rest]), len(self.hashes) - 1)
        found[rest] = self.hashes[at[rest]] == hashes[rest]
        place = self.place[at]
        return np.where(found, self.counts[at], -1), np.where(found & (place >= 0), place, symbol)


BEGIN = CLASSES * WORDS + ENDINGS


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; the biases start at the unigram distribution."""
    random = np.random.default_rng(11)
    words = vocabulary.unigram.reshape(WORDS, CLASSES).T  # every class has words of all frequencies
    mass = np.concatenate([words.sum(1), vocabulary.mass]) + 1e-6
    return {
        "x": random.normal(0, 0.1, (BEGIN + 1, 3 * HIDDEN)).astype(np.float32),
        "u": random.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "c": random.normal(0, 0.05, (HIDDEN, CLASSES + ENDINGS)).astype(np.float32),
        "cb": np.log(mass / mass.sum()).astype(np.float32),
        "w": random.normal(0, 0.05, (CLASSES, HIDDEN, WORDS)).astype(np.float32),
        "wb": np.where(words > 0, np.log(np.maximum(words, 1e-9) / np.maximum(words.sum(1, keepdims=True), 1e-9)), -30).astype(np.float32),
    }


def _class_of(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each symbol, and the word's place in it."""
    frequent = symbol < CLASSES * WORDS
    return np.where(frequent, symbol % CLASSES, symbol - CLASSES * WORDS + CLASSES), symbol // CLASSES


class Recurrence:
    """The network's recurrent part, one window after another: weights by gate (update, reset, candidate), the gates' negated for their sigmoid."""

    def __init__(self, p: dict):
        sign = np.array([-1, -1, 1], np.float32)[:, None, None]
        self.x, self.u = (np.ascontiguousarray(p[name].reshape(-1, 3, HIDDEN).transpose(1, 0, 2)) * sign for name in "xu")

    def run(self, before: np.ndarray, h: np.ndarray, begins: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, ...]:
        """States after each step of a window (steps, lanes, HIDDEN) from inputs and the state before; gates z and r, candidate n and its part by
        the state. Where a step begins documents (begins), states are multiplied by ``carried``. Everything is worked out in place."""
        long, lanes = before.shape
        gates, n = self.x[:2].take(before, axis=1), self.x[2].take(before, axis=0)
        states, by_state = np.empty((2, long, lanes, HIDDEN), np.float32)
        b, rb = np.empty((2, lanes, HIDDEN), np.float32), np.empty((lanes, HIDDEN), np.float32)
        for t in range(long):
            if begins[t]:
                h = h * carried[t]
            own, candidate, after = gates[:, t], n[t], states[t]
            own += np.matmul(h, self.u[:2], out=b)
            np.exp(own, out=own)
            own += 1
            np.reciprocal(own, out=own)
            candidate += np.multiply(own[1], np.matmul(h, self.u[2], out=by_state[t]), out=rb)
            np.tanh(candidate, out=candidate)
            np.subtract(h, candidate, out=after)
            after *= own[0]
            after += candidate
            h = after
        return states, gates[0], gates[1], n, by_state


def _softmax(h: np.ndarray, w: np.ndarray, at: np.ndarray, ones: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logits at some places of the flat array, the exponentials of all and the sums of these; less the largest logit only where the weights allow large ones."""
    e = h @ w
    if large:
        e -= e.max(1, keepdims=True)
    logs = e.reshape(-1).take(at)
    np.exp(e, out=e)
    return logs, e, e @ ones


def _backward(h: np.ndarray, w: np.ndarray, at: np.ndarray, e: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the weights and by the states; the states are divided by the sums, which are wider than they."""
    e.reshape(-1)[at] -= total
    share = (1 / total)[:, None]
    back = e @ w[:-1].T
    back *= share
    return (h * share).T @ e, back


def outputs(p: dict, h: np.ndarray, symbol: np.ndarray, grads: dict | None = None):
    """Natural log-probability of each symbol; with ``grads`` also the gradient by the states."""
    kind, place = _class_of(symbol)
    order = np.argsort(kind.astype(np.uint8), kind="stable")  # of one class next to each other: no gathering for each
    kind, place, rows = kind[order], place[order], np.arange(len(order))
    h = np.concatenate([h[order], np.ones((len(order), 1), h.dtype)], axis=1)  # the biases are the weights of a state that is 1
    c, words = np.concatenate([p["c"], p["cb"][None]]), np.concatenate([p["w"], p["wb"][:, None]], axis=1)
    large, ones = np.abs(words).sum(1).max(1) > 80, np.ones(max(WORDS, CLASSES + ENDINGS), h.dtype)  # states lie within -1 and 1
    at = rows * (CLASSES + ENDINGS) + kind
    found, e, total = _softmax(h, c, at, ones[: CLASSES + ENDINGS], np.abs(c).sum(0).max() > 80)
    back = None
    if grads is not None:
        made, back = _backward(h, c, at, e, total)
        grads["c"] += made[:-1]
        grads["cb"] += made[-1]
    cuts = np.searchsorted(kind, np.arange(CLASSES + 1))
    frequent = slice(0, cuts[CLASSES])
    at = (rows[frequent] - cuts[kind[frequent]]) * WORDS + place[frequent]
    inside, logs = np.empty((2, cuts[CLASSES]), found.dtype)
    for k in range(CLASSES):
        own = slice(cuts[k], cuts[k + 1])
        if cuts[k] == cuts[k + 1]:
            continue
        logs[own], e, inside[own] = _softmax(h[own], words[k], at[own], ones[:WORDS], large[k])
        if grads is not None:
            made, states = _backward(h[own], words[k], at[own], e, inside[own])
            grads["w"][k] += made[:-1]
            grads["wb"][k] += made[-1]
            back[own] += states
    found -= np.log(total)
    found[frequent] += logs - np.log(inside)
    result = np.empty_like(found)
    result[order] = found
    if back is None:
        return result, None
    states = np.empty_like(back)
    states[order] = back
    return result, states


def lanes_of(symbols: np.ndarray, first: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents dealt to lanes of even length: token index (-1: none), input and reset at each step and lane."""
    sizes = np.diff(first)
    heap = [(0, k) for k in range(min(lanes, max(1, len(sizes))))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable"):
        load, k = heapq.heappop(heap)
        dealt[k].append(int(d))
        heapq.heappush(heap, (load + int(sizes[d]), k))
    dealt.sort(key=lambda ds: -sum(sizes[d] for d in ds))
    longest = sum(sizes[d] for d in dealt[0])
    index = np.full((longest, len(dealt)), -1, np.int32)
    for k, ds in enumerate(dealt):
        own = np.concatenate([np.arange(first[d], first[d + 1]) for d in ds]) if ds else np.zeros(0, np.int64)
        index[: len(own), k] = own
    starts = np.zeros(len(symbols), bool)
    starts[first[:-1][sizes > 0]] = True
    before = np.concatenate([np.array([BEGIN], np.int32), symbols[:-1].astype(np.int32)])
    before[starts] = BEGIN
    return index, np.where(index >= 0, before[index], np.int32(BEGIN)), np.where(index >= 0, starts[index], True)


def score_tokens(p: dict, symbols: np.ndarray, first: np.ndarray, lanes: int = 256, window: int = 64) -> np.ndarray:
    """Natural log-probability of each token, the state carried from window to window."""
    found = np.zeros(len(symbols))
    if not len(symbols):
        return found
    index, before, reset = lanes_of(symbols, first, lanes)
    h, begins, recurrence = np.zeros((index.shape[1], HIDDEN), np.float32), (reset & (index >= 0)).any(1), Recurrence(p)
    for at in range(0, len(index), window):
        end = min(at + window, len(index))
        live = int((index[at] >= 0).sum())  # lanes are sorted by length
        states = recurrence.run(before[at:end, :live], h[:live], begins[at:end], (~reset[at:end, :live, None]).astype(np.float32))[0]
        h = states[-1]
        own = index[at:end, :live].ravel()
        keep = own >= 0
        found[own[keep]] = outputs(p, states.reshape(-1, HIDDEN)[keep], symbols[own[keep]])[0]
    return found


def _sum_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, with repeated places."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    lead = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    total[at[order][lead]] += np.add.reduceat(rows[order], lead)


def train(p: dict, symbols: np.ndarray, first: np.ndarray, rate: float, lanes: int = 256, window: int = 24) -> dict:
    """One pass of truncated backpropagation with Adam; windows are longer where few lanes are left."""
    p = {k: v.copy() for k, v in p.items()}
    if not len(symbols):
        return p
    lanes = max(1, min(lanes, CELLS // int(np.diff(first).max())))
    index, before, reset = lanes_of(symbols, first, lanes)
    m, v, count = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    h, at, begins = np.zeros((index.shape[1], HIDDEN), np.float32), 0, (reset & (index >= 0)).any(1)
    while at < len(index):
        live = int((index[at] >= 0).sum())
        end = min(at + window * min(8, index.shape[1] // live), len(index))
        carried = (~reset[at:end, :live, None]).astype(np.float32)
        state, z, r, n, bn = Recurrence(p).run(before[at:end, :live], h[:live], begins[at:end], carried)
        prev = np.concatenate([h[None, :live], state[:-1]])
        prev *= carried
        h = state[-1]
        own = index[at:end, :live].ravel()
        keep = np.flatnonzero(own >= 0)
        grads = {k: np.zeros_like(x) for k, x in p.items()}
        back = np.zeros((len(own), HIDDEN), np.float32)
        back[keep] = outputs(p, state.reshape(-1, HIDDEN)[keep], symbols[own[keep]], grads)[1]
        back = back.reshape(end - at, live, HIDDEN)
        dh, part = np.zeros((2, live, HIDDEN), np.float32)
        db, dn = np.empty((end - at, live, 3 * HIDDEN), np.float32), np.empty((end - at, live, HIDDEN), np.float32)
        to_z, to_r, to_n = (prev - n) * z * (1 - z), bn * r * (1 - r), (1 - z) * (1 - n * n)
        turned = np.ascontiguousarray(p["u"].T)
        for t in range(end - at - 1, -1, -1):
            dh += back[t]
            np.multiply(dh, to_n[t], out=dn[t])
            np.multiply(dh, to_z[t], out=db[t, :, :HIDDEN])
            np.multiply(dn[t], to_r[t], out=db[t, :, HIDDEN : 2 * HIDDEN])
            np.multiply(dn[t], r[t], out=db[t, :, 2 * HIDDEN :])
            dh *= z[t]
            dh += np.matmul(db[t], turned, out=part)
            if begins[at + t]:
                dh *= carried[t]
        grads["u"] += prev.reshape(-1, HIDDEN).T @ db.reshape(-1, 3 * HIDDEN)
        db[:, :, 2 * HIDDEN :] = dn  # the inputs' part of the candidate
        _sum_rows(grads["x"], before[at:end, :live].ravel(), db.reshape(-1, 3 * HIDDEN))
        count += 1
        scale = np.float32(1 / max(1, len(keep)))
        for k, g in grads.items():
            g *= scale
            part = np.subtract(g, m[k])
            part *= np.float32(0.1)
            m[k] += part
            np.multiply(g, g, out=part)
            part -= v[k]
            part *= np.float32(0.01)
            v[k] += part
            np.multiply(v[k], np.float32(1 / (1 - 0.99**count)), out=part)
            np.sqrt(part, out=part)
            part += np.float32(1e-6)
            np.multiply(m[k], np.float32(rate / (1 - 0.9**count)), out=g)
            g /= part
            p[k] -= g
        at = end
    return p


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def summed() -> pa.RecordBatch:
        hashes, code = (np.concatenate(x) for x in zip(*held, strict=True))
        words, at, n = np.unique(hashes, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(code[at]), pa.array(n.astype(np.int64))], ["word", "code", "n"])

    for batch in slices(batches, "text"):
        hashes, code, _ = tokens(batch.column(0))
        held.append((hashes, code))
        size += len(hashes)
        if size > HELD:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()


def _fit(documents: DataFrame, shards: int, vocabulary: Vocabulary, rounds: int) -> dict:
    """Rounds of training by shard, each on documents of its own; the weights are averaged in groups, then over the groups."""
    spark = documents.sparkSession
    params, groups = initial(vocabulary), max(8, math.isqrt(shards))
    for k in range(rounds):
        start, rate = spark.sparkContext.broadcast(params), 0.02 * 0.5**k

        def learn(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            made, seen, held, size = start.value, 0, [], 0

            def learnt() -> dict:
                return train(made, np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])]), rate)

            for batch in batches:
                for x in batch.column(0):
                    held.append(np.frombuffer(x.as_buffer(), np.int16))
                    size += len(held[-1])
                    if size > HELD:
                        made, seen, held, size = learnt(), seen + size, [], 0
            if held:
                made, seen = learnt(), seen + size
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId() % groups]), pa.array([float(seen)]), pa.array([pickle.dumps(made)], pa.binary())], ["part", "n", "made"]
                )

        def average(table: pa.Table) -> pa.Table:
            n, total = table["n"].to_numpy(), None
            for weight, made in zip(n, table["made"], strict=True):
                made = pickle.loads(made.as_py())
                total = {name: x * weight + (total[name] if total else 0) for name, x in made.items()}
            return pa.table({"part": table["part"][:1], "n": [n.sum()], "made": pa.array([pickle.dumps({k: x / n.sum() for k, x in total.items()})], pa.binary())})

        schema = "part long, n double, made binary"
        own = documents.filter(F.col("shard") % rounds == k)
        got = own.repartition(shards, "shard").select("symbols").mapInArrow(lean(learn), schema).groupBy("part").applyInArrow(average, schema).collect()
        if got:
            whole = sum(r["n"] for r in got)
            made = [(r["n"] / whole, pickle.loads(r["made"])) for r in got]
            params = {name: sum(w * m[name] for w, m in made).astype(np.float32) for name in params}
    return params


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, A-Z as a-z, and one end. Counts are of all documents whose id's crc32
    mod 5 is not 1, and nothing else is learnt from. base_score is the unigram log10
    probability with 0.5 added for each type and one unknown; score is the network's.

    Counts of the TABLE most frequent words go to every task; tokens outside it are rows
    that are joined with the counts of all words and summed by document. The network learns
    from every training document once, in one of the rounds; trainers take about SHARD_TOKENS
    each, HELD at a time, and grow in number with the corpus.

    Null and empty texts are an end alone. A null id counts as training; repeated rows are
    scored each. Without training documents everything is unknown. An empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(_quoted(id_col).alias("doc_id"), _quoted(text_col).alias("text"), held_out(_quoted(id_col)).alias("held_out"))
    learnt = rows.filter("NOT held_out").select("text")
    counts = learnt.mapInArrow(lean(_counted), "word long, code int, n long").groupBy("word").agg(F.min("code").alias("code"), F.sum("n").alias("n"))
    counts = materialise(counts, "counts")
    top = counts.orderBy(F.desc("n"), "word").limit(TABLE).toArrow()
    endings = counts.groupBy("code").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toArrow()  # at most 65536 rows
    vocabulary = Vocabulary(top, endings)
    total, types = vocabulary.total, vocabulary.types
    known = spark.sparkContext.broadcast(vocabulary)

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, code, first = tokens(batch.column(1))
            made = known.value.look_up(hashes, code)[1].astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([made[first[k] : first[k + 1]].tobytes() for k in range(len(first) - 1)], pa.binary())], ["shard", "symbols"]
            )

    shards = max(1, math.ceil(total / rounds / SHARD_TOKENS))
    shard = F.pmod(F.xxhash64(_quoted("doc_id"), "text"), F.lit(1_000_000))
    documents = rows.filter("NOT held_out").select(shard.alias("shard"), F.coalesce("text", F.lit("")).alias("text"))
    documents = materialise(documents.mapInArrow(lean(symbols), "shard long, symbols binary"), "lm-training")
    params = spark.sparkContext.broadcast(_fit(documents, shards, vocabulary, rounds))

    names = ["row", "doc_id", "held_out", "n_tokens", "n_found", "base", "model", "word", "times"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held, size = TaskContext.get().partitionId() << 36, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            sizes, symbol, found, base, model = (np.concatenate([x[k] for x in held]) for k in range(2, 7))
            first = np.concatenate([[0], np.cumsum(sizes)])
            n = len(sizes)
            logs = score_tokens(params.value, symbol, first)
            model += np.bincount(np.repeat(np.arange(n), sizes), logs, n) / np.log(10)
            rows = pa.array(part + done + np.arange(n))
            columns = [rows, pa.concat_arrays([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), *map(pa.array, (sizes, found, base, model))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
            start = part + done
            for k in range(len(held)):
                doc, word, times = held[k][7]
                none = [pa.nulls(len(doc), x.type) for x in columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(start + doc), *none, pa.array(word.view(np.int64)), pa.array(times)], names)
                start += len(held[k][2])
            done += n

        for batch in slices(batches, "text"):
            hashes, code, first = tokens(batch.column(1))
            count, symbol = known.value.look_up(hashes, code)
            n, found = len(first) - 1, count >= 0
            doc = np.repeat(np.arange(n), np.diff(first))
            plain = np.where(found, np.log10(np.maximum(count, 0) + 0.5), 0)
            other = symbol >= CLASSES * WORDS
            within = np.where(other, plain - np.log10(known.value.mass)[np.where(other, symbol - CLASSES * WORDS, 0)], 0)
            order = np.lexsort((hashes[~found], doc[~found]))
            word, owner = hashes[~found][order], doc[~found][order]
            lead = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])][: len(word)])
            rare = (owner[lead], word[lead], np.diff(np.append(lead, len(word))))
            sums = (np.bincount(doc, found, n).astype(np.int64), np.bincount(doc, plain, n), np.bincount(doc, within, n))
            held.append((batch.column(0), batch.column(2), np.diff(first), symbol.astype(np.int32), *sums, rare))
            size += len(hashes)
            if size > HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    kind = docs.schema[id_col].dataType.simpleString()
    scored = materialise(
        rows.mapInArrow(lean(score), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_found long, base double, model double, word long, times long"), "scored"
    )
    rare = (
        scored.filter("word IS NOT NULL")
        .select("row", "word", "times")
        .join(counts.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("extra"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        )
    )
    extra = F.coalesce("extra", F.lit(0.0))
    return (
        scored.filter("word IS NULL")
        .join(rare, "row", "left")
        .select(
            F.col("doc_id").alias(id_col),
            "held_out",
            "n_tokens",
            (F.col("n_found") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + extra - F.col("n_tokens") * F.log10(F.lit(total + 0.5 * (types + 1)))).alias("base_score"),
            (F.col("model") + extra).alias("score"),
        )
    )
