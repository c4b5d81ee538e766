"""Token ids against the plain tokenizer, from the encoder to the files and the packed pieces."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cuecraft.llm import tokens
from cuecraft.llm.packing import pack
from cuecraft.llm.rans import ids_round_trip
from cuecraft.llm.tokens import Encoder, tokenizer_path

ODD = [
    "a", "Z", "é", "É", "İ", "ß", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "'", "'s", "'ll", "''", "’", ".", "...", "0", "1", "23",
    "٣", "½", "é", "́", "ά", "Σ", "ſ", "×", "÷", "ŉ", "ǰ", "中", "文", "。", "か", "_", "-", "<|endoftext|>", "\x00", "😀", "ẞ", "Ω", "Å",
]
BOTH = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def expected(name, texts):
    """As the tokenizers' description has it: special tokens' strings are ordinary text."""
    plain = Tokenizer.from_file(tokenizer_path(name))
    plain.encode_special_tokens = True
    return [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "keep"), BOTH)
@pytest.mark.parametrize("small", [False, True])
def test_encoder_equals_the_tokenizer_on_odd_strings(name, keep, small, monkeypatch):
    if small:  # pieces fall out of the table all the time
        monkeypatch.setattr(tokens, "SLOT_BITS", 4)
        monkeypatch.setattr(tokens, "HELD_IDS", 200)
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(15))) for _ in range(4000)]
    texts += [None, "0", "a0 0", "\n", "x" * 3000, "ab1" * 700, " " * 50 + "y", "word " * 500, "don't stop. Now"]
    encoder, want = Encoder(tokenizer_path(name), keep), expected(name, texts)
    for at in range(0, len(texts), 500):
        ids, first = encoder.encode(pa.array(texts[at : at + 500]), end=1)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [x + [1] for x in want[at : at + 500]]


ROWS = [(3, "One text, and more of it. " * 90), (1, None), (2, ""), (7, "ü é don't \n\n x"), (5, "One text, and more of it. " * 90), (40, "z" * 900 + " 12 345")]


def test_files_hold_ids_in_order(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ids_round_trip(docs, tokenizer_path("word_bpe_49k.json")).collect()}
    start, rows = 0, sorted(ROWS)
    for (i, _), ids in zip(rows, expected("word_bpe_49k.json", [t for _, t in rows]), strict=True):
        raw = np.array(ids + [1], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4


def test_pieces_hold_the_tokenizers_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    ids, places = dict(zip([i for i, _ in ROWS], expected("byte_bpe_50k.json", [t for _, t in ROWS]), strict=True)), defaultdict(list)
    for r in pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=64, tail=4).collect():
        own = (ids[r.doc_id] + [1])[r.start : r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(np.array(own, "<u4").tobytes()), len(ids[r.doc_id]) + 1)
        places[r.doc_id].append((r.start, r.length))
    for i, spans in places.items():
        assert [a for a, _ in sorted(spans)] == np.cumsum([0, *[n for _, n in sorted(spans)]])[:-1].tolist()
        assert sum(n for _, n in spans) == len(ids[i]) + 1
    assert set(places) == set(ids)
