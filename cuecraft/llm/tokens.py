"""Token ids of whole texts by a public tokenizer, with repeated pieces encoded once."""

from __future__ import annotations

import functools
import re
import sys

import numpy as np
import pyarrow as pa

from .common import LOWER, SHORT, buffers, hash_slices, kept

#: Slots of the table of pieces that a Python worker remembers, and the ids it holds before it starts anew: under 50 MB.
SLOT_BITS, HELD_IDS = 21, 1 << 23
#: Longer pieces, in bytes, are encoded each time they come.
LONGEST = SHORT

LETTER, DIGIT, MARK, OTHER, BLANK, ODD = range(6)
#: What a byte is: ASCII by its kind, C3 to C9 begin (and later bytes continue) Latin letters.
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:128] = MARK
_KIND[0x30:0x3A] = DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
_KIND[0x1C:0x20] = ODD
#: Visible characters of which none is white space anywhere: pieces of them are encoded many at a time, with a separator.
_WIDE = rb"[\xc3-\xdf][\x80-\xbf]|\xe3[\x81-\xbf][\x80-\xbf]|[\xe4-\xef][\x80-\xbf]{2}|\xf0[\x80-\xbf]{3}"
#: By keep_space: a separator that is a token of its own and the pieces that can't hold it.
_JOINED = {True: ("\n", re.compile(rb" ?(?:[!-~]|" + _WIDE + rb")+")), False: (" 0 ", re.compile(rb"(?:[!-/1-~]|" + _WIDE + rb")+"))}
_encoders: dict[tuple[str, bool], Encoder] = {}
kept.append(_encoders)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte; white space beyond ASCII is ODD, as are characters next to which nothing is cut for certain."""
    kind = _KIND[data]
    wide = np.flatnonzero(data >= 0xC2)
    if len(wide):
        lead = data[wide]
        two = wide[(lead >= 0xC3) & (lead <= 0xC9)]
        kind[two + 1] = LETTER
        second = data[two + 1]
        # the signs for times and divided by, and the one letter whose lower case is two characters
        for at in (two[(data[two] == 0xC3) & ((second == 0x97) | (second == 0xB7))], two[(data[two] == 0xC4) & (second == 0xB0)]):
            kind[at] = kind[at + 1] = OTHER
        at = wide[lead == 0xC2]
        at = at[np.isin(data[at + 1], (0x85, 0xA0))]
        kind[at] = kind[at + 1] = ODD
        at = wide[(lead >= 0xE1) & (lead <= 0xE3)]
        if len(at):
            code = (data[at].astype(np.uint32) << 16) | (data[at + 1].astype(np.uint32) << 8) | data[at + 2]
            blank = (code == 0xE19A80) | ((code >= 0xE28080) & (code <= 0xE2808A)) | np.isin(code, (0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080))
            at = at[blank]
            kind[at] = kind[at + 1] = kind[at + 2] = ODD
    return kind


def cut_pieces(data: np.ndarray, offsets: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of pieces: every tokenizer that splits words, numbers, marks and white space begins anew at each."""
    n = len(data)
    kind = kinds(data)
    a, b = kind[:-1], kind[1:]
    cut = np.zeros(n + 1, bool)
    # letters, digits and marks apart, but nothing after an apostrophe that may begin a shortened word
    inner = (a != b) & (a < OTHER) & (b < OTHER) & ~((data[:-1] == 0x27) & (b == LETTER))
    blank = kind == BLANK
    if keep_space:
        seen = kind < BLANK
        ends = np.zeros(n, bool)  # a blank that a visible character of its text follows
        ends[:-1] = blank[:-1] & seen[1:]
        last = offsets[1:][(offsets[1:] > offsets[:-1])] - 1
        ends[last] = False
        cut[:n] = ends
        cut[1:n] |= inner | (blank[1:] & seen[:-1]) | (ends[:-1] & (data[:-1] != 0x20))
    else:
        cut[1:n] = inner | (blank[1:] != blank[:-1])
    cut[offsets] = True
    starts = np.flatnonzero(cut[:n])
    sizes = np.diff(np.append(starts, n))
    if keep_space:
        return starts, sizes
    seen = ~blank[starts]
    return starts[seen], sizes[seen]


class Encoder:
    """Ids of texts, from a table of pieces of fixed size that forgets as it fills.

    The tokenizer splits a text into words before it merges anything, so a text may be cut
    where such a split is certain and each piece encoded by itself. With ``keep_space``
    white space is part of the ids and a space belongs to the piece that follows; without it white
    space only separates and letters have no case. Strings of special tokens in a text are
    ordinary text, as the tokenizers' own description sets it (``encode_special_tokens``).
    """

    def __init__(self, path: str, keep_space: bool):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.size, self._keep_space = size, keep_space
        self._separator, self._simple = _JOINED[keep_space]
        (self._separator_id,) = self._tokenizer.encode(self._separator, add_special_tokens=False).ids
        if sys.byteorder != "little":
            raise RuntimeError("ids are kept as little-endian bytes")
        self._forget()

    def _forget(self) -> None:
        slots = 1 << SLOT_BITS
        self._tag, self._at, self._n = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int16)
        self._ids, self._used = np.zeros(1 << 16, self.dtype), 0

    @classmethod
    def shared(cls, path: str, keep_space: bool) -> Encoder:
        """One encoder per Python worker."""
        key = (path, keep_space)
        if key not in _encoders:
            _encoders[key] = cls(path, keep_space)
        return _encoders[key]

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        fits = self._simple.fullmatch
        simple = [len(x) <= LONGEST and fits(x) is not None for x in pieces]
        most, sep = 4096, self._separator.encode()
        own = [x for x, fit in zip(pieces, simple, strict=True) if fit]
        joined = [(sep.join(own[at : at + most]) + sep).decode() for at in range(0, len(own), most)]
        rest = [x.decode() for x, fit in zip(pieces, simple, strict=True) if not fit]
        encode = functools.partial(self._tokenizer.encode_batch_fast, add_special_tokens=False)
        together = [np.array(e.ids, self.dtype) for e in encode(joined)] if joined else []
        alone = [np.array(e.ids, self.dtype) for at in range(0, len(rest), most) for e in encode(rest[at : at + most])]
        ids = np.concatenate([np.zeros(0, self.dtype), *together])
        stops = np.flatnonzero(ids == self._separator_id)
        if len(stops) != len(own):
            raise ValueError("a separator of pieces is not a token of its own")
        n = np.empty(len(pieces), np.int64)
        n[simple] = np.diff(np.concatenate([[-1], stops])) - 1
        n[~np.array(simple, bool)] = [len(x) for x in alone]
        flat = np.empty(int(n.sum()), self.dtype)
        of_simple = np.repeat(np.array(simple, bool), n)
        flat[of_simple] = ids[ids != self._separator_id]
        flat[~of_simple] = np.concatenate([np.zeros(0, self.dtype), *alone])
        return flat, n

    def _add(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Appends ids to those held; where each piece's begin."""
        if self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids[: self._used], np.zeros(self._used + len(flat), self.dtype)])
        self._ids[self._used : self._used + len(flat)] = flat
        at = self._used + np.cumsum(n) - n
        self._used += len(flat)
        return at

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids of all texts one after the other, each with the id ``end`` behind it if one is given."""
        data, offsets = buffers(column)
        if self._used > HELD_IDS:
            self._forget()
        if not self._keep_space:
            data = LOWER[data]
        starts, sizes = cut_pieces(data, offsets, self._keep_space) if len(data) else (np.zeros(0, np.int64),) * 2
        hashes = hash_slices(data, starts, np.minimum(sizes, LONGEST)) | np.uint64(1)  # 0 marks a free slot
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, n = self._at[slot].astype(np.int64), self._n[slot].astype(np.int64)
        miss = np.flatnonzero((self._tag[slot] != hashes) | (sizes > LONGEST))
        if len(miss):
            key = hashes[miss]
            long = sizes[miss] > LONGEST
            key[long] = np.flatnonzero(long)  # each by itself; even or odd, a hash of a short piece may be the same
            kind = np.stack([key, long.astype(np.uint64)])
            order = np.lexsort(kind)
            kind = kind[:, order]
            lead = np.concatenate([[True], (kind[:, 1:] != kind[:, :-1]).any(0)])
            new, which = miss[order[lead]], np.empty(len(miss), np.int64)
            which[order] = np.cumsum(lead) - 1
            raw, a, s = data.tobytes(), starts[new].tolist(), sizes[new].tolist()
            flat, count = self._encoded([raw[x : x + y] for x, y in zip(a, s, strict=True)])
            base = self._add(flat, count)
            at[miss], n[miss] = base[which], count[which]
            keep = sizes[new] <= LONGEST
            place = slot[new[keep]]
            self._tag[place], self._at[place], self._n[place] = hashes[new[keep]], base[keep], count[keep]
            # of two new pieces in one slot the last one written stays in all three
            clash = self._tag[place] != hashes[new[keep]]
            if clash.any():
                twice = place[clash]
                self._tag[twice] = 0
        before = np.cumsum(n) - n
        total = int(n.sum())
        ids = self._ids[np.repeat(at - before, n) + np.arange(total)]
        ahead = np.append(before, total)[np.searchsorted(starts, offsets)]
        if end is None:
            return ids, ahead
        docs = len(offsets) - 1
        first = ahead + np.arange(docs + 1)
        out, own = np.empty(total + docs, self.dtype), np.ones(total + docs, bool)
        own[first[1:] - 1] = False
        out[first[1:] - 1] = end
        out[own] = ids
        return out, first
