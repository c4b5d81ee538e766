"""The ten operators against brute force on small tables with nulls, empty and repeated rows."""

import base64
import hashlib
import math
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuecraft.llm import files, html_text, ngram_join, rans, repeats, warc
from cuecraft.llm.decontaminate import decontaminate
from cuecraft.llm.exact_dedup import exact_dedup
from cuecraft.llm.lm import score_documents
from cuecraft.llm.ngram_join import similar
from cuecraft.llm.packing import cut, pack
from cuecraft.llm.tokens import Encoder, tokenizer_path
from cuecraft.llm.toxicity import fit, score_toxicity

SF = "/root/testdata/sf0.001"
LOREM = " ".join(f"w{k * 7919 % 1009}" for k in range(400))
ROWS = [
    (1, LOREM, "x"), (2, None, None), (3, "", "x"), (4, LOREM.replace(" ", "\n"), "x"), (5, LOREM + " tail", "x"), (5, LOREM + " tail", "x"), (6, "short one", "x"),
    (7, "Short  ONE", "x"), (8, "a" * 3000, "x"), (9, LOREM.replace("w7 ", "zz ") + " more", "x"), (10, "é ü " + LOREM[:900] + " ñ", None), (11, " \t\n", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that clash with names of results."""
    rows = [(i, t, k, 0, "n") for i, t, k in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, `odd name` string")


def none_of(docs):
    return docs.filter("false")


def test_exact_dedup(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[norm(t)].append((-len(t or ""), i))
    want = sorted((i, min(groups[norm(t)])[1], len(groups[norm(t)])) for i, t, _ in ROWS)
    for bits in (6, 22):
        got = exact_dedup(docs, filter_bits=bits)
        assert "odd name" in got.columns
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == want
    assert exact_dedup(none_of(docs)).count() == 0


def words(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("small", [False, True])
def test_similar(docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 64)
        monkeypatch.setattr(ngram_join, "TILE_BYTES", 4096)
        monkeypatch.setattr(ngram_join, "COLUMNS", 16)
        monkeypatch.setattr(ngram_join, "CROWD", 2)
        monkeypatch.setattr(ngram_join, "FREQUENT", 20)
    sets = []
    for i, t, _ in ROWS:
        w = words(t)
        sets.append((i, {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()))
    low = {k: i for k, (i, _) in enumerate(sets)}
    for _ in sets:
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    low[a] = low[b] = min(low[a], low[b])
    want = sorted((i, len(s), low[k]) for k, (i, s) in enumerate(sets))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar(docs, 85, 4).collect()) == want
    assert similar(none_of(docs)).count() == 0


def test_similar_in_a_crowd(spark):
    rng, base = np.random.default_rng(3), [f"v{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 4), replace=False):
            w[k] = f"u{i}x{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in similar(spark.createDataFrame(rows, "doc_id long, text string"), 85, 4).collect()}
    sets = [{tuple(t.split()[k : k + 4]) for k in range(117)} for _, t in rows]
    low = list(range(150))
    for _ in range(6):
        for a in range(150):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert got == dict(enumerate(low))


def repeated_brute(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[k : k + n] for x in raw for k in range(len(x) - n + 1))
    out = []
    for x in raw:
        hit = np.zeros(len(x), bool)
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                hit[k : k + n] = True
        out.append(bytes(np.frombuffer(x, np.uint8)[~hit]))
    return out


@pytest.mark.parametrize("group_rows", [1 << 16, 1, 2, 4])
def test_repeats(docs, group_rows):
    extra = [(20 + k, f"q{k} " * 5 + LOREM[100 * k : 100 * k + 620] + f" r{k}" * 9, "x", 0, "n") for k in range(6)]
    table = docs.unionByName(docs.sparkSession.createDataFrame(extra, docs.schema))
    got = sorted((r.doc_id, bytes(r.kept)) for r in repeats.repeated(table, group_rows=group_rows).collect())
    texts = [(i, t) for i, t, *_ in ROWS] + [(e[0], e[1]) for e in extra]
    assert got == sorted(zip([i for i, _ in texts], repeated_brute([t for _, t in texts], 400), strict=True))
    assert repeats.repeated(none_of(docs)).count() == 0


def test_suffix_scan_against_pairs():
    rng = np.random.default_rng(1)
    for _ in range(30):
        texts = [bytes(rng.choice(list(b"ab"), 12).astype(np.uint8)) for _ in range(12)]
        lefts, rights = [t[:6][::-1] for t in texts], [b"xxxx" + t[6:] for t in texts]
        l, r = repeats.scan(np.zeros(12, np.int64), lefts, rights, 10, 4)
        same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905, E731
        for a in range(12):
            pairs = [(same(lefts[a], lefts[b]), same(rights[a], rights[b])) for b in range(12) if b != a]
            good = [(x, y) for x, y in pairs if x + y >= 10]
            assert (l[a], r[a]) == (max((x for x, _ in good), default=0), max((y for _, y in good), default=0))


def test_packing(docs):
    path, capacity = tokenizer_path("byte_bpe_50k.json"), 256
    encoder = Encoder(path, True)
    ids = defaultdict(list)
    for i, t, _ in ROWS:
        ids[i].append(encoder.encode(pa.array([t], pa.string()), end=1)[0].tolist())
    rows = pack(docs, path, capacity=capacity, tail=16).collect()
    places, tokens = defaultdict(list), Counter()
    for r in rows:
        own = ids[r.doc_id][0]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id] += r.length
    assert tokens == {i: sum(map(len, x)) for i, x in ids.items()}
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= sum(tokens.values()) / capacity * 1.05 + 1
    assert pack(none_of(docs), path).count() == 0
    for n in range(1, 700):
        pieces = cut(n, 256, 16)
        assert sum(x for x, _ in pieces) == n and all(x * k <= 256 for x, k in pieces)


def test_token_files(docs, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    encoder = Encoder(path, False)
    rows = rans.read_ids(rans.write_ids(docs, f"file://{tmp_path}", path), keep_ids=True).collect()
    want = sorted((i, encoder.encode(pa.array([t], pa.string()), end=1)[0].tolist()) for i, t, _ in ROWS)
    assert sorted((r.doc_id, list(r.ids)) for r in rows) == want
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert rans.ids_round_trip(none_of(docs), path).count() == 0


def test_rans_checkpoints_and_checksums(monkeypatch):
    monkeypatch.setattr(rans, "LANES", 16)
    monkeypatch.setattr(rans, "STRIDE", 8)
    ids = np.random.default_rng(0).zipf(1.3, 1000).clip(0, 499).astype(np.uint16)
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=500)))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    for mark in range(8):
        part = coder.decode(block, mark, 1)
        assert (part == ids[mark * 128 : mark * 128 + len(part)]).all()
    with pytest.raises(ValueError):
        coder.decode(block[:-1] + bytes([block[-1] ^ 1]))


def test_warc(spark, tmp_path, monkeypatch):
    rows = [(3, "http://a/é b", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://c", None), (4, "http://d", ""), (5, "http://e", "ü"), (1, None, "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", first[h or ""] if first[h or ""] != i else -1) for i, _, h in rows)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in warc.warc_round_trip(pages).collect())
    assert got == want
    assert warc.warc_round_trip(pages.filter("false")).count() == 0


def test_warc_of_a_payload_that_most_pages_have(spark):
    """Pages of a frequent payload lie in many archives, and results are those of a plain grouping."""
    rows = [(k, f"http://h/{k}", "same " * 40 if k % 3 else f"own {k // 6}") for k in range(3000)] + [(None, None, "own 0"), (7, "http://h/7", "same " * 40)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    firsts: dict = {}
    for k, _, html in rows:
        firsts[html] = min(firsts.get(html, (True, 1 << 60)), (k is not None, k if k is not None else 0))
    copies, want = Counter(h for _, _, h in rows), []
    for k, _, html in rows:
        known, least = firsts[html]
        least = least if known else None
        revisit = copies[html] > 1 and k != least
        want.append((k, len(html), warc.payload_digest(html.encode()), "revisit" if revisit else "response", least if revisit else None))
    got = warc.warc_round_trip(table).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        made = [r.records for r in warc.write_archives(table, warc.shared_dir(spark, "spread")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(made) == len(rows) and max(made) < len(rows) / 3


def test_zip64_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "x.wacz"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a/first", b"0123456789" * 9)
        z.writestr("b/second", b"the record")
    source = files.Ranges()
    found = warc.members(source, str(path))
    assert source.read(str(path), *found["b/second"]) == b"the record"
    assert source.read(str(path), *found["a/first"])[:10] == b"0123456789"
    assert struct.pack("<I", 0x06064B50) in path.read_bytes()


def test_decontaminate(docs, spark):
    w = LOREM.split()
    items = [(1, " ".join(w[50:75])), (2, "short one"), (3, None), (4, " ".join(w[200:212] + ["no"] * 5)), (5, "nothing of it"), (6, "SHORT, one!"), (None, " ".join(w[100:113])), (None, "short"), (7, " ".join(w[300:330])), (7, " ".join(w[300:330])), (1, " ".join(w[52:66])), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = []
    for i, t, _ in ROWS:
        d, hit, found = words(t, pattern), set(), set()
        for item, text in items:
            b = words(text, pattern)
            n = min(13, len(b))
            windows = {tuple(b[k : k + n]) for k in range(max(0, len(b) - n + 1))} if n else set()
            for k in range(len(d) - n + 1):
                if n and tuple(d[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(item)
        want.append((i, len(d), len(hit), sorted(found, key=str)))
    for limit in (1 << 20, 0):
        rows = decontaminate(docs, bench, broadcast_bytes=limit).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, sorted(set(r.hit_items), key=str)) for r in rows) == sorted(want, key=lambda x: x[0])
        assert {len(r.hit_items) - len(set(r.hit_items)) for r in rows if r.doc_id == 1} == {2}  # items with one id count by themselves
        assert all(r.n_hit == sum(s.end - s.start for s in r.hit_spans) for r in rows)
    assert all(r.n_hit == 0 for r in decontaminate(docs, bench.filter("false")).collect())


def test_language_model(spark):
    rows = [(i, f"the {'cat' if i % 2 else 'dog'} sat on the {'mat' if i % 2 else 'log'} again " * 6) for i in range(60)] + [(60, None), (61, "UNSEEN words"), (62, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in score_documents(docs).collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = {i: words(t) + ["\0"] for i, t in rows}
    c = Counter(w for i in tokens if not out(i) for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(i), len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base)
    held = [got[i] for i in range(60) if out(i)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert score_documents(docs.filter("false")).count() == 0


def test_toxicity(spark):
    rng, plain = np.random.default_rng(2), [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(300):
        w = [plain[k] for k in rng.choice(300, rng.integers(5, 60))]
        if i % 4 == 0:
            w[2:4] = ["vile", "scoundrel"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(300, None), (301, ""), (302, "é vile scoundrel here and there now")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, fit(docs, labels)).collect()}
    wrong = [i for i in range(300) if (got[i].toxic_score >= 0.3) != (i % 4 == 0)]
    assert len(wrong) <= 6
    assert all(0 <= r.toxic_score <= 1 for r in got.values())
    span = got[302].toxic_spans[0]
    assert rows[302][1][span.start : span.end] == "vile scoundrel"
    assert score_toxicity(docs.filter("false"), fit(docs, labels.filter("false"))).count() == 0


def test_html(spark):
    rows = [
        (1, "u", "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First\n  block here.<p>Second <b>one</b></article><div class='ad'>Buy this</div><footer>&copy; x</footer>"),
        (2, "u", None), (3, "u", ""), (4, "u", "<div class=cookie-notice>We use cookies</div>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    trees = html_text.train(["some words of plain text that go on for a while"] * 5 + ["short"], layouts=250)
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(pages, trees).collect()}
    assert got[1][0] == "A & B\nFirst block here.\nSecond one"
    assert got[2] == got[3] == ("", 0)


def test_decoding_keeps_no_child_of_a_dropped_node():
    page = html_text.Page("<div><div><p>a</p></div><p>b</p></div>")
    kept = page.decode(np.array([0.0, -5.0, 3.0, 3.0, -1.0]))
    assert not any(kept[k] and not kept[page.parent[k]] for k in range(1, len(kept)))


def shingled(t, n):
    w = words(t)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def contaminated_brute(t, windows):
    d, hit = words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
    for n, own in windows.items():
        for k in range(len(d) - n + 1):
            if tuple(d[k : k + n]) in own:
                hit |= set(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(d)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage against brute force over what it reads; nulls, empty texts, repeated rows and columns of other names included."""
    folder = str(tmp_path / "sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"kept": F.lit("x"), "n_hit": F.lit(1)})
    odd = [(-1, None), (-2, ""), (-3, " \n"), (-4, LOREM), (-4, LOREM), (-5, LOREM + " one more"), (None, "no id at all")]
    extra = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c not in ("doc_id", "text")})
    docs.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r.text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        n = min(13, len(w))
        windows[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()

    def toxicity(rows):
        """By the scores of the same model; what is clean or has no words stays."""
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        scores = score_toxicity(docs, fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
        kept = [r.doc_id for r in scores if r.toxic_score < 0.3]
        clean = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 0").collect()}
        assert {-1, -2, -3} <= set(kept) and len(clean - set(kept)) <= 0.02 * len(rows)
        return kept

    def exact(rows):
        best = {}
        for r in rows:
            key, rank = re.sub(r"[\x20\x09-\x0d]", "", r.text or ""), (-len(r.text or ""), r.doc_id is not None, r.doc_id or 0)
            best[key] = min(best.get(key, (rank, r.doc_id)), (rank, r.doc_id))
        return [r.doc_id for r in rows if best[re.sub(r"[\x20\x09-\x0d]", "", r.text or "")][1] == r.doc_id]

    def near(rows):
        sets = [shingled(r.text, 5) for r in rows]
        low = list(range(len(rows)))

        def root(k):
            while low[k] != k:
                k = low[k]
            return k

        holders = defaultdict(list)
        for k, s in enumerate(sets):
            for g in s:
                holders[g].append(k)
        pairs = Counter((a, b) for own in holders.values() for a in own for b in own if a < b)
        for (a, b), n in pairs.items():
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                low[max(root(a), root(b))] = min(root(a), root(b))
        least = {}
        for k, r in enumerate(rows):
            if r.doc_id is not None:
                least[root(k)] = min(least.get(root(k), r.doc_id), r.doc_id)
        return [r.doc_id for k, r in enumerate(rows) if r.doc_id is None or least[root(k)] == r.doc_id]

    def clean(rows):
        return [r.doc_id for r in rows if not contaminated_brute(r.text, windows)]

    docs, order = spark.read.parquet(f"{folder}/documents.parquet"), lambda ids: sorted(ids, key=lambda x: (x is not None, x or 0))
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (toxicity, exact, near, clean), strict=True):
        rows, columns = docs.collect(), docs.columns
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        got = [r.doc_id for r in docs.collect()]
        got_ids = set(got)
        assert order(got) == order(want(rows)), name
        assert len(got) > len(rows) / 2
        assert stage(spark, docs.filter("false"), folder).count() == 0
    packed = corpus_pipeline.run(spark, folder)
    assert packed.select("doc_id").distinct().count() == len(got_ids)
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_buffers_of_slices():
    from cuecraft.llm.common import Words

    column = pa.array(["x", None, "A b", ""]).slice(1)
    w = Words(column)
    assert np.diff(w.first).tolist() == [0, 2, 0]


def test_the_network_learns_from_every_training_document(spark, monkeypatch):
    from cuecraft.llm import lm

    seen, shards_of = [], []
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    monkeypatch.setattr(lm, "TRAIN_TOKENS", 1000, raising=False)  # a bound on what is learnt from would show

    def fit(documents, shards, vocabulary, rounds):
        shards_of.append(shards)
        seen.append(documents.withColumn("round", F.col("shard") % rounds).collect())
        return plain(documents, shards, vocabulary, rounds)

    plain = lm._fit
    monkeypatch.setattr(lm, "_fit", fit)
    docs = spark.createDataFrame([(i, f"a b c {i} " * 10) for i in range(400)], "doc_id long, text string")
    for table in (docs, docs.unionByName(docs.selectExpr("doc_id + 400 AS doc_id", "text"))):
        got = {r.doc_id: r for r in score_documents(table).collect()}
        learnt = [r for r in got.values() if not r.held_out]
        assert len(seen[-1]) == len(learnt)
        assert sum(len(r.symbols) // 2 for r in seen[-1]) == learnt[0].train_tokens
        assert {r.round for r in seen[-1]} == set(range(lm.ROUNDS))
    assert shards_of[1] > 1.8 * shards_of[0]


def test_trainers_take_their_documents_in_bounded_windows(monkeypatch):
    from cuecraft.llm import lm

    sizes = np.array([5, 1, 3000, 40, 0, 7])
    first = np.concatenate([[0], np.cumsum(sizes)])
    symbols = (np.arange(first[-1]) * 7 % 50).astype(np.int16)
    vocabulary = lm.Vocabulary(
        pa.table({"word": np.arange(60), "code": np.zeros(60, np.int64), "n": np.full(60, 9)}), pa.table({"code": np.array([0]), "n": np.array([540]), "words": np.array([60])})
    )
    start, laid = lm.initial(vocabulary), []
    plain = lm.lanes_of
    monkeypatch.setattr(lm, "lanes_of", lambda *a: laid.append(plain(*a)) or laid[-1])
    monkeypatch.setattr(lm, "CELLS", 6000)
    made = lm.train(start, symbols, first, 0.01)
    index = laid[0][0]
    assert index.size <= 6200
    assert sorted(index[index >= 0]) == list(range(first[-1]))
    assert lm.score_tokens(made, symbols.astype(np.int32), first).sum() > lm.score_tokens(start, symbols.astype(np.int32), first).sum()


def test_marginals_equal_enumeration(monkeypatch):
    import itertools

    from cuecraft.llm import toxicity

    rng = np.random.default_rng(4)
    for chunk in (2, 3, 64):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        sizes = [5, 0, 1, 7, 2]
        first = np.concatenate([[0], np.cumsum(sizes)])
        score, trans = rng.normal(0, 2, first[-1]), rng.normal(0, 1, (2, 2))
        got, pairs = toxicity.Chains(first).marginals(score, trans)
        want, moves = np.zeros(first[-1]), np.zeros((2, 2))
        for d, n in enumerate(sizes):
            own, total, sums, steps = score[first[d] : first[d + 1]], 0.0, np.zeros(n), np.zeros((2, 2))
            for tags in itertools.product((0, 1), repeat=n):
                before = (0, *tags[:-1])
                weight = math.exp(sum(own[k] * y + trans[b, y] for k, (b, y) in enumerate(zip(before, tags, strict=False))))
                total += weight
                sums += weight * np.array(tags)
                for b, y in zip(before, tags, strict=False):
                    steps[b, y] += weight
            if n:
                want[first[d] : first[d + 1]] = sums / total
                moves += steps / total
        assert got == pytest.approx(want) and pairs == pytest.approx(moves)


def test_long_labelled_texts_train(spark):
    rows = [(i, ("plain words here " * 900 + ("vile scoundrel " if i % 3 == 0 else "kind person ") + "and more text " * 900)) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = fit(docs.withColumn("text", F.concat("text", F.col("doc_id").cast("string"))), labels)
    got = score_toxicity(spark.createDataFrame([(0, "a vile scoundrel came"), (1, "a kind person came"), (1, "a kind person came")], "doc_id long, text string"), model).collect()
    by = sorted((r.text, r.toxic_score) for r in got)
    assert by[0][1] == by[1][1] < by[2][1]


def test_scores_equal_a_plain_loop():
    from cuecraft.llm import lm

    rng, sizes = np.random.default_rng(9), np.array([4, 0, 70, 1, 200])
    first = np.concatenate([[0], np.cumsum(sizes)])
    symbols = rng.integers(0, lm.BEGIN, first[-1]).astype(np.int32)
    h, c, w = lm.HIDDEN, lm.CLASSES, lm.WORDS
    shapes = {"x": (lm.BEGIN + 1, 3 * h), "u": (h, 3 * h), "c": (h, c + lm.ENDINGS), "cb": (c + lm.ENDINGS,), "w": (c, h, w), "wb": (c, w)}
    p = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()}
    got = lm.score_tokens(p, symbols, first, lanes=3, window=16)
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    for d in range(len(sizes)):
        state, before = np.zeros(h), lm.BEGIN
        for k in range(first[d], first[d + 1]):
            a, b = p["x"][before], state @ p["u"]
            z, r = sigmoid(a[:h] + b[:h]), sigmoid(a[h : 2 * h] + b[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :])
            s = int(symbols[k])
            kind = s % c if s < c * w else c + s - c * w
            logits = state @ p["c"] + p["cb"]
            want = logits[kind] - np.log(np.exp(logits).sum())
            if s < c * w:
                inner = state @ p["w"][kind] + p["wb"][kind]
                want += inner[s // c] - np.log(np.exp(inner).sum())
            assert got[k] == pytest.approx(want, abs=1e-4)
            before = s


def test_pages_of_any_markup_take_linear_time():
    import time

    cases = {
        '<p title="unclosed>r</p>': ["r"], "<p data-k=abc data-k>x</p>": ["x"], "a<wbr>b <img src=x>c<br>d": ["ab c d"], "<noscript>no</noscript>x<noscript>y<p>z": ["xy", "z"],
        "<select><option>a<p>rest": ["a", "rest"], "<p>1 < 2 &lt; 4</p>": ["1 < 2 < 4"], "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": ["a", "b", "c", "d", "e"],
        "<table><tr><td>a<td>b<tr><td>c</table>d": ["a", "b", "c", "d"], "\u0130<title>x</title>ok<textarea>": ["\u0130ok"], "<a href='x>y'>l</a><!-- <p> -->m": ["lm"],
    }
    for source, runs in cases.items():
        assert html_text.Page(source).runs == runs
    for source in ("<a " * 350_000, "<div>" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<div>" * 50_000 + "<li>x" * 50_000, "<button>" * 100_000 + "</button>", "<" * 500_000):
        began = time.process_time()
        html_text.Page(source)
        assert time.process_time() - began < 8  # a third of a second to two where nothing else runs; quadratic reading takes minutes


def test_held_out_layouts():
    """Precision and recall of the words kept, over layouts that the trees have not seen."""
    runs = [" ".join(f"word{k * j % 97}" for j in range(1, 4 + k % 40)) for k in range(1, 300)]
    trees = html_text.train(runs, layouts=350, seed=1)
    rng, kept, right, wanted = np.random.default_rng(77), 0, 0, 0
    for _ in range(120):
        page = html_text.Page(html_text._layout(rng, runs), marked=True)
        truth = [True]
        for k in range(1, len(page.parent)):
            truth.append(truth[page.parent[k]] if page.label[k] is None else page.label[k] == 1)
        got = page.decode(trees.margin(page.features()))
        for run, node in zip(page.runs, page.owner, strict=True):
            n = len(run.split())
            kept, right, wanted = kept + n * got[node], right + n * (got[node] and truth[node]), wanted + n * truth[node]
    assert right / kept > 0.95 and right / wanted > 0.95


def test_extraction_of_odd_tables(spark):
    assert html_text.fit(spark.createDataFrame([], "page_id long, html string")).margin(html_text.Page("<p>x</p>").features()).shape == (2,)
    rows = [(1, "<article><p>Same text of a page here.</p></article>", "a"), (1, "<article><p>Same text of a page here.</p></article>", "a"), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extract_text(pages, html_text.fit(pages)).collect()
    assert len(got) == 3 and got[0].asDict().keys() == {"page_id", "html", "text", "n_chars"}
    assert len({r.text for r in got if r.html}) == 1


def test_repeats_of_passages_of_many_lengths(spark, monkeypatch):
    """Passages just under and over the length, in many documents and far into long ones, read in pieces."""
    monkeypatch.setattr(repeats, "LONG", 1500)
    monkeypatch.setattr(repeats, "HOT_ROWS", 3)
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(90)[:n] for n in (398, 399, 400, 401, 430)]
    rows = [(i, text(30 + 40 * (i % 9)) + " " + passages[i % 5] + " " + text(5 + i), 0, 0) for i in range(40)]
    rows += [(100, text(3000) + passages[4] + text(2000) + passages[2], 0, 0), (101, passages[3] * 3, 0, 0), (102, None, 0, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, start int, digest int").repartition(5)
    got = {r.doc_id: (bytes(r.kept), len(r.repeated_spans)) for r in repeats.repeated(table).collect()}
    kept = repeated_brute([t for _, t, *_ in rows], 400)
    for (i, t, *_), want in zip(rows, kept, strict=True):
        assert got[i][0] == want
        assert (got[i][1] == 0) == (len(want) == len((t or "").encode()))


def test_intermediate_tables_can_be_swept(spark):
    from pathlib import Path

    from cuecraft.llm import common

    path = common.shared_dir(spark, "swept")
    spark.range(3).write.parquet(path)
    assert Path(path.removeprefix("file://")).exists()
    assert common.sweep() >= 1 and not Path(path.removeprefix("file://")).exists()
    assert common.sweep() == 0


def test_batches_are_bounded_by_bytes(spark):
    from cuecraft.llm import common

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    common.lean(lambda batches: batches)
    assert common._bytes(spark.conf.get(setting)) <= common.BATCH_BYTES
    assert [common._bytes(x) for x in ("64m", "4194304", "1g", "7KB")] == [64 << 20, 4194304, 1 << 30, 7 << 10]
