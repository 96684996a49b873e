"""Encoding of a whole corpus with a byte-level BPE vocabulary (problem 8).

Two tiers. A minimal perfect hash over the vocabulary resolves whole pre-tokens, all of a batch at once: pre-tokens are
found by arithmetic on character classes, and their keys come from one running hash over the batch's bytes. What misses
is cut where no token of the vocabulary spans two neighbouring bytes, which no merge can cross; those parts go through
the same hash, and what still misses is merged with a heap over linked bytes, once per different part.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LETTER, NUMBER, SPACE = 1, 2, 3
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
CHUNK = 1 << 20
MEMO = 200_000


def default_vocabulary() -> str:
    """The path of byte_bpe_50k among the installed public tokenizers, or what FACTLOOM_BPE names."""
    if named := os.environ.get("FACTLOOM_BPE"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        for m in regex.finditer(f"{pattern}+", every):
            points = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            out[points] = kind
    return out


def _mix(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(seed, np.uint64) * np.uint64(0x94D049BB133111EB)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... lengths[i] numbers each, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


class Vocabulary:
    """Tables of one vocabulary file (lines of base64 token and rank); built once and sent to the workers."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        tokens = [base64.b64decode(a) for a, _ in pairs]
        self.ids = np.array([int(b) for _, b in pairs], np.int32)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.joined = np.zeros((256, 256), bool)
        inside = np.ones(len(self.blob), bool)
        inside[self.start] = False
        at = np.flatnonzero(inside)
        self.joined[self.blob[at - 1], self.blob[at]] = True
        self.classes = character_classes()
        self._perfect_hash()

    def _perfect_hash(self) -> None:
        """Hash and displace: one displacement per bucket puts every key into a slot of its own, with no slot free."""
        n = len(self.ids)
        h = Hashes(self.blob).of(self.start, self.start + self.length)
        self.buckets = max(1, n // 4)
        bucket = (_mix(h, 0) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        self.shift, self.slot, free = np.zeros(self.buckets, np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
        tries = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-size, kind="stable"):
            keys = order[first[b] : first[b] + size[b]]
            if size[b] == 0:
                break
            if size[b] == 1:  # straight to a free slot
                at = int(np.argmax(free))
                self.shift[b], self.slot[at], free[at] = -at - 1, keys[0], False
                continue
            start = 0
            while True:
                to = (_mix(h[keys][None, :], (tries + np.uint64(start))[:, None]) % np.uint64(n)).astype(np.int64)
                good = free[to].all(axis=1)
                if good.any():
                    for t in np.flatnonzero(good):
                        if len(set(to[t].tolist())) == size[b]:
                            break
                    else:
                        start += 256
                        continue
                    self.shift[b], self.slot[to[t]], free[to[t]] = start + int(tries[t]), keys, False
                    break
                start += 256

    def find(self, data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The number of the token that is data[s:e], or -1; every hit is compared byte by byte."""
        shift = self.shift[(_mix(h, 0) % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, (_mix(h, np.maximum(shift, 0)) % np.uint64(len(self.ids))).astype(np.int64))
        key = self.slot[slot]
        key = np.where(self.length[key] == e - s, key, -1)
        hit = np.flatnonzero(key >= 0)
        if len(hit):
            n = self.length[key[hit]]
            same = data[_ranges(s[hit], n)] == self.blob[_ranges(self.start[key[hit]], n)]
            bad = ~np.logical_and.reduceat(same, np.cumsum(n) - n)
            key[hit[bad]] = -1
        return key


class Hashes:
    """64-bit hashes of any parts of data, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        powers = _powers(BASE, len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
        self.back = _powers(BASE_INV, len(data) + 1)

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.sums[e] - self.sums[s]) * self.back[s]


def pretoken_starts(points: np.ndarray, classes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token: contractions, runs of letters, numbers or signs with a blank before, spaces."""
    n = len(points)
    kind = classes[points]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start, at = run.copy(), np.flatnonzero(run)
    begin, end = at[:-1], at[1:]
    # of white space before other text the last character stands apart; a blank goes with what follows
    white = np.flatnonzero((kind[begin] == SPACE) & ~first[end])
    last = end[white] - 1
    start[last] = True
    blank = points[last] == 0x20
    start[end[white][blank]] = False
    # contractions: a lone apostrophe that begins a pre-token, and certain letters
    lone = begin[(end - begin == 1) & (points[begin] == 0x27)]
    lone = lone[start[lone] & ~first[lone + 1]]
    lone = lone[kind[lone + 1] == LETTER] if len(lone) else lone
    if len(lone):
        one = points[lone + 1]
        two = np.where(run[np.minimum(lone + 2, n)], 0, points[np.minimum(lone + 2, n - 1)])
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        short = np.isin(one, (0x73, 0x74, 0x6D, 0x64)) & ~long
        for which, width in ((short, 2), (long, 3)):
            start[lone[which] + 1] = False
            start[lone[which] + width] = True
    return start[:n]


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        v = vocabulary
        self.rank = {v.blob[s : s + n].tobytes(): int(i) for s, n, i in zip(v.start, v.length, v.ids, strict=True)}
        self.memo: dict[bytes, list[int]] = {}
        self.flat, self.filled = np.concatenate((v.ids, np.zeros(1 << 16, np.int32))), len(v.ids)
        self.point_start, self.point_count = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int8)

    def merge(self, part: bytes) -> list[int]:
        """Ids of bytes by merging neighbours, the lowest rank first and of equal ranks the leftmost."""
        if (known := self.memo.get(part)) is not None:
            return known
        n, rank = len(part), self.rank
        piece: list[bytes | None] = [part[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, width = heapq.heappop(heap)
            j = after[i] if piece[i] is not None else n
            if j >= n or len(piece[i]) + len(piece[j]) != width:
                continue
            piece[i], piece[j] = piece[i] + piece[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n:
                    both = piece[x] + piece[y]
                    if (r := rank.get(both)) is not None:
                        heapq.heappush(heap, (r, x, len(both)))
        out = [rank[p] for p in piece if p is not None]
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[part] = out
        return out

    def encode(self, data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text; text_starts are the first bytes of the (non-empty) texts."""
        v, n = self.v, len(data)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        wide = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at_byte = np.cumsum(wide, dtype=np.int64) - wide
        starts = pretoken_starts(points, v.classes, np.searchsorted(at_byte, text_starts))
        first = np.flatnonzero(starts)
        s = at_byte[first]
        e = np.append(s[1:], n)
        hashes = Hashes(data)
        token = v.find(data, hashes.of(s, e), s, e)
        # pre-tokens that aren't tokens fall into parts, at characters that no merge can join
        open_point = np.repeat(token < 0, np.diff(np.append(first, len(points))))
        cut = open_point & ~v.joined[data[at_byte - 1], data[at_byte]] | starts
        part = np.flatnonzero(cut)
        width = np.diff(np.append(part, len(points)))
        code = token[np.cumsum(starts[part]) - 1]
        flat_start, counts = np.maximum(code, 0), np.ones(len(part), np.int64)
        single = np.flatnonzero((code < 0) & (width == 1))
        flat_start[single], counts[single] = self._characters(points[part[single]])
        tables = self.flat[: self.filled]
        longer = np.flatnonzero((code < 0) & (width > 1))
        if len(longer):
            s2 = at_byte[part[longer]]
            e2 = np.append(at_byte, n)[part[longer] + width[longer]]
            h2 = hashes.of(s2, e2)
            found = v.find(data, h2, s2, e2)
            flat_start[longer] = np.maximum(found, 0)
            rest = np.flatnonzero(found < 0)
            rs, re_ = s2[rest], e2[rest]
            _, pick, which = np.unique(h2[rest], return_index=True, return_inverse=True)
            other = self._unequal(data, rs, re_, rs[pick][which], re_[pick][which])
            if len(other):  # different parts of one hash
                which[other] = np.arange(len(other)) + len(pick)
                pick = np.concatenate((pick, other))
            raw = data.tobytes()
            lists = [self.merge(raw[a:b]) for a, b in zip(rs[pick].tolist(), re_[pick].tolist(), strict=True)]
            sizes = np.array([len(x) for x in lists], np.int64)
            begins = len(tables) + np.cumsum(sizes) - sizes
            tables = np.concatenate((tables, np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))))
            counts[longer[rest]] = sizes[which]
            flat_start[longer[rest]] = begins[which]
        ids = tables[_ranges(flat_start, counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))
        text_parts = np.append(np.searchsorted(at_byte[part], text_starts), len(part))
        return ids, np.diff(ends[text_parts])

    def _characters(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of single characters stand in the flat table, and how many; each character is merged once."""
        for c in np.unique(points[self.point_count[points] == 0]).tolist():
            ids = self.merge(chr(c).encode())
            if self.filled + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.int32)))
            self.flat[self.filled : self.filled + len(ids)] = ids
            self.point_start[c], self.point_count[c] = self.filled, len(ids)
            self.filled += len(ids)
        return self.point_start[points], self.point_count[points]

    @staticmethod
    def _unequal(data: np.ndarray, s: np.ndarray, e: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
        n, differs = e - s, (e - s) != (e2 - s2)
        same = np.flatnonzero(~differs)
        equal = data[_ranges(s[same], n[same])] == data[_ranges(s2[same], n[same])]
        if len(same):
            differs[same] = ~np.logical_and.reduceat(equal, np.cumsum(n[same]) - n[same])
        return np.flatnonzero(differs)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of a string array; null and empty texts have none. Whole texts, about CHUNK bytes a time."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        if texts.null_count:
            sizes = np.where(np.asarray(texts.is_null()), 0, sizes)
        counts, ids = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        filled = np.flatnonzero(sizes)
        group = (np.cumsum(sizes[filled]) - sizes[filled]) // CHUNK
        for part in np.split(filled, np.flatnonzero(np.diff(group)) + 1) if len(filled) else []:
            n = sizes[part]
            own = data[_ranges(offsets[:-1][part], n)] if n.sum() != offsets[part[-1] + 1] - offsets[part[0]] else data[offsets[part[0]] : offsets[part[-1] + 1]]
            got, counts[part] = self.encode(own, np.cumsum(n) - n)
            ids.append(got)
        return np.concatenate(ids), counts


_encoders: dict[str, Encoder] = {}
_vocabularies: dict[str, Vocabulary] = {}


def _encoder(path: str, sent) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(sent.value)
    return _encoders[path]


def _sent(df: DataFrame, path: str):
    """The vocabulary's tables, a few MB whatever the corpus, as a broadcast."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return df.sparkSession.sparkContext.broadcast(_vocabularies[path])


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens; null and empty texts give an empty list.

    Strings that look like special tokens are ordinary text. One pass without a shuffle; other columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    sent = _sent(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts = _encoder(path, sent).batch(b.column(1))
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens): the number of token ids of every text; null and empty texts have 0."""
    path = vocabulary or default_vocabulary()
    sent = _sent(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = _encoder(path, sent).batch(b.column(1))[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, n_tokens long").withColumnRenamed("key", key)
