"""Byte-level BPE of texts by segments that encode alone as they do in their text.

The tokenizer's pre-tokens never run across a single blank or line feed between two
characters that are no white space: the blank opens the next pre-token and the line feed
is one of its own. A text is therefore cut at such places, found from a few bytes around
each, and each distinct segment that a worker's store does not hold is given to the
library, many of them joined to one text at such places.

Only for tokenizers whose model is byte-level BPE with the usual pre-token pattern, no
normalizer and no prefix blank; ``Encoder`` refuses others.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from .arrays import SLICE_BYTES, slices, span_hashes

_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
# Leads of two- and three-byte characters among which white space occurs.
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC2:0xF5] = True
_OPENS = _GRAPHIC | (_LEAD & ~_DOUBTFUL)

_MOST_SEGMENTS = 600_000  # kept per worker; beyond, those met once are forgotten
_AT_ONCE = 4_096
_LONG = 1_024  # bytes of a segment that stays a text of its own


def _closed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is surely no white space."""
    one, two, three = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3))
    wide = _CONTINUES[one] & (
        (_LEAD[two] & ~_DOUBTFUL[two]) | (_CONTINUES[two] & ((_LEAD[three] & ~_DOUBTFUL[three]) | _CONTINUES[three]))
    )
    return _GRAPHIC[one] | wide


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of consecutive spans."""
    upto = np.cumsum(size, dtype=np.int64)
    return np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the segments of a slice of rows, each row's first byte among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    first, last = offsets[:-1], offsets[1:] - 1
    first, last = first[first < n], last[last >= 0]
    inner = (data == 0x20) | (data == 0x0A)
    inner[first] = inner[last] = False
    place = np.flatnonzero(inner)
    place = place[_OPENS[data[place + 1]]]
    place = place[_closed(data, place)]
    cut = np.zeros(n, bool)
    cut[place] = cut[place[data[place] == 0x0A] + 1] = cut[first] = True
    return np.flatnonzero(cut)


class Encoder:
    """The library's ids of segments; those met lately are in a store."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        added = spec.get("added_tokens") or []
        if not plain or spec.get("normalizer") or any(
            t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in added
        ):
            raise ValueError(f"{path}: segments need plain byte-level BPE")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        # Bytes of each token; a character of a byte-level token stands for one.
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        for t in added:
            self.widths[t["id"]] = len(t["content"].encode())
        self.keys = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int32)  # slices each segment was in
        self.count = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the segments met again, the most often met ones and half a store at most."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > _MOST_SEGMENTS // 2:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[: _MOST_SEGMENTS // 2]])
        place = np.full(len(self.met), -1)
        place[keep] = np.arange(len(keep))
        where = place[self.where]
        self.keys, self.where = self.keys[where >= 0], where[where >= 0]
        self.met, self.count = self.met[keep] // 2, self.count[keep]
        self.ids = self.ids[_spans(self.begin[keep], self.count)]
        self.begin = np.cumsum(self.count, dtype=np.int64) - self.count

    def _apart(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each segment, ids), each segment a text of its own."""
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts, ends)]
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int32, len(found))
        return count, np.fromiter((i for ids in found for i in ids), np.int32, int(count.sum()))

    def _together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from one text, cut where the bytes of its tokens reach a segment's end.

        Every segment ends in a character that is no white space, and opens with a blank
        before such a character or, after a line feed put in, with such a character: both
        are places where segments encode alone.
        """
        size = ends - starts
        feed = data[starts] != 0x20
        feed[:1] = False
        end = np.cumsum(size + feed)
        text = np.full(end[-1], 0x0A, np.uint8)
        text[_spans(end - size, size)] = data[_spans(starts, size)]
        try:
            whole = text.tobytes().decode()
        except UnicodeDecodeError:
            return self._apart(data, starts, ends)
        ids = np.array(self.library.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.int32)
        upto = np.concatenate(([0], np.cumsum(self.widths[ids])))
        a, b = np.searchsorted(upto, end - size), np.searchsorted(upto, end)
        if upto[-1] != len(text) or (upto[a] != end - size).any() or (upto[b] != end).any():
            return self._apart(data, starts, ends)
        return (b - a).astype(np.int32), ids[_spans(a, b - a)]

    def _learn(self, at: np.ndarray, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add segments, ``at`` being where their hashes belong among the keys."""
        second = data[np.minimum(starts + 1, ends - 1)]
        plain = (_OPENS[data[starts]] | ((data[starts] == 0x20) & _OPENS[second])) & _closed(data, ends)
        plain &= ends - starts < _LONG
        where, counts, ids = np.empty(len(starts), np.int64), [], []
        known = len(self.count)
        for encode, rows in ((self._together, np.flatnonzero(plain)), (self._apart, np.flatnonzero(~plain))):
            for lo in range(0, len(rows), _AT_ONCE):  # the library's results are large until their ids are taken
                some = rows[lo : lo + _AT_ONCE]
                where[some] = known + np.arange(len(some))
                known += len(some)
                c, i = encode(data, starts[some], ends[some])
                counts.append(c)
                ids.append(i)
        count = np.concatenate(counts)
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(count, dtype=np.int64) - count))
        self.count = np.concatenate((self.count, count))
        self.met = np.concatenate((self.met, np.zeros(len(count), np.int32)))
        self.ids = np.concatenate((self.ids, *ids))
        self.keys, self.where = np.insert(self.keys, at, hashes), np.insert(self.where, at, where)

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, store index) of the segments of a slice of rows; valid until the next call."""
        starts = segment_starts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        if len(self.keys) > _MOST_SEGMENTS:
            self._forget()
        h = span_hashes(data, starts, ends)
        distinct, one, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(at[new], distinct[new], data, starts[one[new]], ends[one[new]])
            at = np.searchsorted(self.keys, distinct)
        where = self.where[at]
        self.met[where] += 1
        return starts, where[back]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of a batch."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for lo, hi in slices(offsets, SLICE_BYTES):
            local = offsets[lo : hi + 1] - offsets[lo]
            starts, index = self.segments(data[offsets[lo] : offsets[hi]], local)
            upto = np.concatenate(([0], np.cumsum(self.count[index])))
            out[lo:hi] = np.diff(upto[np.searchsorted(starts, local)])
        return out

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens of each row) of one slice of rows."""
        starts, index = self.segments(data, offsets)
        count = self.count[index].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(count)))
        return self.ids[_spans(self.begin[index], count)], np.diff(upto[np.searchsorted(starts, offsets)])


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)
