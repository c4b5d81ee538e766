"""Prefix trie, fill-in-middle and chat formatting against brute force on odd tables."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cuecraft.llm.chat import as_log, escaped, format_chat, read_chat, reconstruct, unescaped
from cuecraft.llm.infill import Exceptions, fill_in_middle, restored
from cuecraft.llm.trie import CountMin, conversation_trie

CONV = "conv_id long, turn long, role string, text string"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(230), 299, 300, 412, 500, -7, -100]:
        base = rng.choice(["hello", "hello", "hi ü"])
        for t in range(rng.choice([0, 1, 1, 2, 3, 6, 7])):
            rows.append((c, t, rng.choice(["user", "user", "assistant", None]), rng.choice([base, base, None, f"own {c}"])))
    for c in range(600, 640):  # copies
        rows += [(c, t, "user", f"same {t}") for t in range(9)]
    rows += [(700, t, "user", f"long {t}") for t in range(150)] + [(701, t, "user", f"long {t}") for t in range(149)]
    rows += [(800, None, "user", "x"), (800, 1, "user", "y"), (800, 1, "user", "y"), (800, 1, "assistant", "a"), (None, 0, "user", "nobody")]
    return rows


def trie_brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append(((t is not None, t or 0, sha(f"{len(r)}:{r}{x}")), (r, x)))
    turns = {c: [v for _, v in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out, below = [], {}
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        parts = [below[x] for x in kids[k]]
        below[k] = (sum(p[0] for p in parts) or 1, saved + sum(p[1] for p in parts))
        ends = ",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), *below[k], sha(ends)))
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [(1 << 12, 1 << 26), (2, 2), (64, 64)])
def test_trie(spark, cells):
    """Also with sketches far too small, by which all or many prefixes may be shared."""
    rows = conversations()
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], CONV + ", depth int, `odd name` string").repartition(5)
    assert sorted(map(tuple, conversation_trie(table, cells).collect()), key=str) == trie_brute(rows)


def test_trie_of_little(spark):
    assert conversation_trie(spark.createDataFrame([], CONV)).count() == 0
    one = [(7, 0, "user", "x" * 3_000_000)]
    assert sorted(map(tuple, conversation_trie(spark.createDataFrame(one, CONV)).collect()), key=str) == trie_brute(one)
    turnless = [(k, 0, "user", "x") for k in (1, 2, 3, 4)]  # the base is absent and heads may take all
    assert sorted(map(tuple, conversation_trie(spark.createDataFrame(turnless, CONV)).collect()), key=str) == trie_brute(turnless)


def test_count_min_never_counts_too_low():
    rng = np.random.default_rng(0)
    kinds = rng.integers(0, 256, (500, 16), dtype=np.uint8)
    drawn = rng.integers(0, 500, 2000)
    counts = CountMin(1024)
    for part in np.array_split(drawn, 7):
        counts.add(kinds[part])
    true = np.bincount(drawn, minlength=500)
    assert (counts.estimate(kinds) >= np.minimum(true, 255)).all()
    assert (counts.estimate(kinds) == np.minimum(true, 255)).mean() > 0.7


# ---------------------------------------------------------------- fill-in-middle

TEXTS = [None, "", " ", "\t\n ", "a", " a", "a ", "é", "naïve café 𝄞𝄞 x", "one <P> two", "<S>", "x<", "a<M>", "a <P b", "日本 語\x0b\x0c\r x  ", "a b  c", "word " * 50_000, "ü" * 300_001, "one two three four five six"] + [
    f"w{k} ä{k}  𝄞 end{k}\n" * (k % 7) for k in range(60)]


def fim_brute(i, text, unit, rate=50, spm=80):
    t = text or ""
    s = sha("42:" + ("" if i is None else str(i)))
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", t) if unit == "word" else list(t)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(q in t for q in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}"


@pytest.mark.parametrize("unit", ["word", "char"])
def test_fill_in_middle(spark, unit):
    rows = [(k, t, "old", 1) for k, t in enumerate(TEXTS)] + [(None, "no id at all", "old", 1), (18, TEXTS[18], "again", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, FIM_FORM string, `odd name` int")
    made = fill_in_middle(table, unit=unit, rate=90, spm=50)
    assert made.columns == ["doc_id", "text", "odd name", "fim_units", "fim_form", "prefix_chars", "middle_chars", "fim_text"]
    got = made.select("doc_id", "odd name", "fim_units", "fim_form", "prefix_chars", "middle_chars", "fim_text", restored(made.fim_text, made.fim_form).alias("back"), "text").collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(str((i, q, *fim_brute(i, t, unit, 90, 50))) for i, t, _, q in rows)
    assert all(r.back == (r.text or "") for r in got)
    assert {"plain", "spm", "psm"} == {r.fim_form for r in got}
    assert fill_in_middle(table.filter("false"), unit=unit).count() == 0
    assert "text" not in fill_in_middle(table, keep_text=False).columns


def test_exception_index():
    text = "aé𝄞b日 c" * 50
    data = np.frombuffer(text.encode(), np.uint8)
    index = Exceptions(data)
    at = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert (index.chars(at) == np.arange(len(text) + 1)).all()
    assert (index.bytes(np.arange(len(text) + 1)) == at).all()
    assert len(Exceptions(np.frombuffer(b"ascii" * 99, np.uint8)).at) == 0


# ---------------------------------------------------------------- chat

TRICKS = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>", "[ROLE]x[SAYS]y[/ROLE]", "[/INST", "<", "[", "[[INST]<</s>", "\\", "", None, "s>", "/INST]", "[s>", "a\nb", "$1\\2"]


def fold_brute(log):
    """One event after the other, as a service would apply them."""
    talks = defaultdict(dict)
    seen = {tuple(e) for e in log}
    low = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    for c, _, m, kind, role, t in sorted(seen, key=lambda e: (str(e[0]), low(e[1]), low(e[2]), text(e[3]), text(e[4]), text(e[5] or ""))):
        talk = talks[c]
        if kind == "regenerate":
            for later in [x for x in talk if m is not None and x is not None and x > m]:
                del talk[later]
        old_role, old = talk.get(m, (None, ""))
        new = "" if kind == "regenerate" else (t or "") if kind in ("message", "edit") else old + (t or "")
        talk[m] = (role if role is not None else old_role, new)
    return sorted(((c, m, r or "", t) for c, talk in talks.items() for m, (r, t) in talk.items()), key=str)


def test_reconstruct(spark):
    rng = random.Random(2)
    log = []
    for c in (1, 2, 3, None):
        for k in range(120):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", None, "other"])
            log.append((c, rng.choice([k, k, None]), rng.choice([0, 1, 2, 3, None]), kind, rng.choice(["user", "assistant", None, None]), rng.choice(["a", "bc", None, "é", ""])))
    log += log[:40]  # delivered twice
    table = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string").repartition(4)
    assert sorted(map(tuple, reconstruct(table).collect()), key=str) == fold_brute(log)
    assert format_chat(table.filter("false")).count() == 0
    assert sorted(r.conv_id for r in format_chat(table).collect() if r.conv_id) == [1, 2, 3]


def test_format_and_read_back(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([t, t, None]), rng.choice(["user", "assistant", "system", None, "[/ROLE]", "to\nol"]), rng.choice(TRICKS)) for c in (*range(30), None) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "assistant", f"é{t}" * 400) for t in range(300)] + [(100, 0, "user", "long ü " * 300_000)]
    rows += [(5, 3, "user", "twice")] * 2
    formatted = format_chat(as_log(spark.createDataFrame([(*r, "x") for r in rows], CONV + ", formatted string"), delta=7))
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    spans = {r.conv_id: r for r in formatted.collect()}
    for row in read_chat(formatted).collect():
        turns = [v[2:] for v in sorted(want[row.conv_id])]
        assert [tuple(t) for t in row.turns] == turns
        assert row.loss_text == "".join(x for r, x in turns if r == "assistant")
        at = 0
        for s, (r, x) in zip(spans[row.conv_id].turn_spans, turns, strict=True):
            assert s.start == at and s.loss == (r == "assistant")
            inner = row.formatted[s.text_start : s.text_end]
            assert re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\]|/?ROLE\]|SAYS\])", r"\1\2\3", inner) == x
            assert not re.search(r"</?s>|\[/?INST\]|\[/?ROLE\]|\[SAYS\]", inner)
            at = s.end
        assert at == len(row.formatted)
    assert set(spans) == set(want)
    odd = spark.createDataFrame([(1, None), (2, "")], "conv_id long, formatted string").selectExpr("*", "cast(array() AS array<struct<start:bigint,text_start:bigint,text_end:bigint,end:bigint,loss:boolean>>) AS turn_spans")
    assert [(r.turns, r.loss_text) for r in read_chat(odd).collect()] == [([], "")] * 2


def test_escape_is_reversible(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "ROLE]", "SAYS]", "a"]) for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = table.select("t", escaped(table.t).alias("e")).select("t", "e", unescaped(escaped(table.t)).alias("u")).collect()
    assert all(r.u == r.t for r in rows)
    assert not any(re.search(r"</?s>|\[/?INST\]|\[/?ROLE\]|\[SAYS\]", r.e) for r in rows)
    assert json.dumps([r.t for r in rows if r.e != r.t])
