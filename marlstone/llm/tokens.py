"""Exact byte-level BPE encoding, vectorised over documents.

The vocabulary file's pre-tokeniser is a regular language over four character
classes (letter, number, white space, other), so pieces are found with NumPy
passes over code points. Strings of added tokens are cut out first, as
``tokenizers`` does, and are one id each. Each distinct piece is merged once per
worker and looked up by a 64-bit hash afterwards; a hit counts only if its bytes
are those of the piece, and pieces that merely share a hash are merged by themselves.
Ids equal those of ``tokenizers`` on the same file (tests compare them).
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa

from marlstone.llm.common import mix, powers, slices

END_OF_TEXT = 2
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Unicode's White_Space property.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The pre-tokeniser's contractions.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
CACHE_LIMIT = 400_000  # pieces, some 50 bytes each; beyond it a worker, which lives on for other stages, starts its cache anew

_classes: np.ndarray | None = None
_encoders: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def char_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        _classes[WHITE] = SPACE
    return _classes


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every pre-token of documents [offsets[i], offsets[i+1])."""
    n = len(points)
    cls = char_classes()[points]
    head = np.zeros(n + 1, bool)  # a document starts here
    head[offsets] = True
    start = head[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    run = np.flatnonzero(start)  # runs of one class within one document
    run_end = np.append(run[1:], n)
    # the last white space before a run belongs to that run if it is a plain blank,
    # and is a piece of its own otherwise
    gaps = cls[run] == SPACE
    followed = gaps & ~head[run_end]
    last = run_end[followed] - 1
    start[last] = True
    blank = last[points[last] == 0x20]
    start[blank + 1] = False
    for at in np.flatnonzero(points == 0x27):  # contractions at a piece's start
        if not start[at]:
            continue
        stop = at + 1
        while stop < n and not head[stop] and stop - at <= 2:
            stop += 1
        tail = "".join(map(chr, points[at + 1 : min(stop, at + 3)]))
        hit = next((c for c in CONTRACTIONS if tail.startswith(c)), None)
        if hit:
            end = at + 1 + len(hit)
            start[at + 1 : end] = False
            if end < n:
                start[end] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of the vocabulary file at ``path``; strings of its added tokens become their ids."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        self.added = {t["content"].encode(): t["id"] for t in content.get("added_tokens", [])}
        self.cut = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed rule of byte-level vocabularies
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in content["model"]["vocab"].items() if all(c in byte_of for c in word)}
        for t in self.added:
            ranks.pop(t, None)
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.clear()

    def clear(self) -> None:
        """Pieces in the order they came: the i-th one's ids are flat[at[i]:at[i + 1]], its bytes raw[raw_at[i]:raw_at[i + 1]];
        ``keys`` ascend, and ``rows`` are their pieces."""
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.raw = Growing(np.uint32), Growing(np.uint8)
        self.at, self.raw_at = Growing(np.int64), Growing(np.int64)
        for offsets in (self.at, self.raw_at):
            offsets.add([0])

    def _ids(self, piece: bytes) -> list[int]:
        return [self.added[piece]] if piece in self.added else self.merge(piece)

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        """Add pieces by ascending keys."""
        ids = [self._ids(t) for t in texts]
        for offsets, values, lists in ((self.at, self.flat, ids), (self.raw_at, self.raw, texts)):
            offsets.add(values.size + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))
        self.flat.add([x for i in ids for x in i])
        self.raw.add(np.frombuffer(b"".join(texts), np.uint8))
        where = np.searchsorted(self.keys, keys)
        self.rows = np.insert(self.rows, where, len(self.keys) + np.arange(len(keys)))
        self.keys = np.insert(self.keys, where, keys)

    def encode(self, data: np.ndarray, offsets: np.ndarray, count_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, each document's first index); without ids if only counts are asked for."""
        text = data.tobytes()
        points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each code point
        upto = np.searchsorted(byte_at, offsets)  # documents' offsets in code points
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = self._starts(text, points, byte_at, offsets, upto)
        ends = np.append(starts[1:], len(points))
        prefix = np.zeros(len(points) + 1, np.uint64)
        up, down = powers(len(points) + 1)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
        keys = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        unique, example, back = np.unique(keys, return_index=True, return_inverse=True)
        first, size = byte_at[starts], byte_at[ends] - byte_at[starts]  # pieces follow each other without gaps
        known = self._find(unique)[1] if len(self.keys) else np.zeros(len(unique), bool)
        if not known.all():
            if len(self.keys) > CACHE_LIMIT:
                self.clear()
                known[:] = False
            new = example[~known]
            self._learn(unique[~known], [text[a:b] for a, b in zip(first[new].tolist(), (first[new] + size[new]).tolist(), strict=True)])
        found, raw_at = self.rows[self._find(unique)[0]], self.raw_at.values
        fits = raw_at[found + 1] - raw_at[found] == size[example]
        held = found[fits]
        fits[fits] = _same(self.raw.values, raw_at[held], data, first[example[fits]], size[example[fits]])
        row, right = found[back], fits[back] & (size == size[example[back]])
        right[right] = _same(data, first[example[back[right]]], data, first[right], size[right])
        at, flat = self.at.values, self.flat.values
        wrong = np.flatnonzero(~right)
        if len(wrong):  # an equal hash of other bytes
            ids = [self._ids(text[a : a + n]) for a, n in zip(first[wrong].tolist(), size[wrong].tolist(), strict=True)]
            row[wrong] = len(self.keys) + np.arange(len(wrong))
            at = np.concatenate((at, at[-1] + np.cumsum([len(i) for i in ids])))
            flat = np.concatenate((flat, np.array([x for i in ids for x in i], np.uint32)))
        number = (at[row + 1] - at[row]).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(number)))
        heads = total[np.searchsorted(starts, upto)]
        if count_only:
            return np.zeros(0, np.uint32), heads
        return flat[np.repeat(at[row] - total[:-1], number) + np.arange(total[-1])], heads

    def _starts(self, text: bytes, points: np.ndarray, byte_at: np.ndarray, offsets: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Starts of all pieces; an added token within one document is a piece, and what it parts is split by itself."""
        hits: list[tuple[int, int]] = []
        if self.cut is not None and (m := self.cut.search(text)):
            for d in range(int(np.searchsorted(offsets, m.start(), "right")) - 1, len(offsets) - 1):
                hits += [x.span() for x in self.cut.finditer(text, int(offsets[d]), int(offsets[d + 1]))]
        if not hits:
            return piece_starts(points, upto)
        low, high = (np.searchsorted(byte_at, x) for x in zip(*hits, strict=True))
        starts = piece_starts(points, np.unique(np.concatenate((upto, low, high))))
        inside = np.searchsorted(low, starts, "left") - 1  # the token that begins before it
        return starts[(inside < 0) | (starts >= high[inside])]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return row, self.keys[row] == keys


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype: type) -> None:
        self.data, self.size = np.zeros(1024, dtype), 0

    @property
    def values(self) -> np.ndarray:
        return self.data[: self.size]

    def add(self, values) -> None:
        values = np.asarray(values, self.data.dtype)
        if self.size + len(values) > len(self.data):
            larger = np.empty(2 * self.size + len(values), self.data.dtype)  # what is not used takes no memory
            larger[: self.size] = self.values
            self.data = larger
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)


def _same(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[a_start:a_start + size] equals b[b_start:b_start + size], for each range."""
    total = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(total[-1])
    differ = a[np.repeat(a_start - total[:-1], size) + place] != b[np.repeat(b_start - total[:-1], size) + place]
    out = np.ones(len(size), bool)
    out[np.searchsorted(total, np.flatnonzero(differ), "right") - 1] = False
    return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str, count_only: bool = False):
    """Yield (first row, end row, ids, first index of each row) for a text column."""
    e = encoder(path)
    for at, end, data, offsets in slices(column):
        yield at, end, *e.encode(data, offsets, count_only)
