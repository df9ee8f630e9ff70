"""Byte-level encoding with content-defined chunks.

A rolling hash of the last ``WINDOW`` bytes cuts every text at places that depend on the bytes
around them alone, so copies and shared passages fall into the same chunks wherever they stand.
A chunk is encoded as it is cut, by itself, and one that this worker has met is not encoded again.

The ids at a chunk's ends depend on its neighbours, so each join is repaired: a range around the
cut is encoded anew, and its outermost unit on either side must get the ids that the chunk there
gives it; if not, the range widens by a unit on that side, up to the ends of the text. A unit
begins at a white-space byte after a byte of another kind, which no piece of the vocabulary's
pattern spans, so ids that agree over a whole unit agree from there on. Ranges that overlap are
one. Texts in which white space does not tell units apart are one chunk each.

Chunks are shared between the texts of a worker's tasks, not across workers: sending every chunk
to a common owner would move the whole corpus twice to save encodings that a worker makes in a
fraction of that time. The store of chunks is a cache; its size changes the time alone.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from netsight.llm.common import map_texts, texts, window_hashes
from netsight.llm.tokens import Encoder, encoder

WINDOW = 32
MEAN_CHUNK = 1024
CACHE_CHUNKS = 1 << 14
ENCODED = "doc_id long, ids binary, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Coded(NamedTuple):
    """A stretch of text: its ids, the byte where each ends, and the bytes they decode to."""

    ids: np.ndarray
    ends: np.ndarray
    letters: bytes

    def rows(self, low: int, high: int) -> tuple[int, int] | None:
        """Which ids make up the bytes from ``low`` to ``high``; None if one reaches over an end."""
        at = np.searchsorted(self.ends, (low, high), "right").tolist()
        whole = all(place == (self.ends[i - 1] if i else 0) for place, i in zip((low, high), at, strict=True))
        return (at[0], at[1]) if whole else None


class Chunks:
    """Encoded chunks by their 128-bit digest."""

    def __init__(self, codec: Encoder, capacity: int = CACHE_CHUNKS):
        self.codec, self.capacity, self.known = codec, capacity, {}
        tokens = [codec.vocabulary.get(i, b"") for i in range(max(codec.vocabulary) + 1)]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and where those of each id end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.letters[np.arange(total) + np.repeat(self.first[ids] - (ends - sizes), sizes)], ends

    def cuts(self, data: np.ndarray, offsets: np.ndarray, mean: int) -> np.ndarray:
        """Where the rolling hash cuts within the texts, each at the next start of a character."""
        cuts = np.flatnonzero(window_hashes(data.astype(np.uint64), WINDOW) < np.uint64((1 << 64) // mean)) + WINDOW
        text = np.searchsorted(offsets, cuts, "right") - 1
        fit = (cuts < len(data)) & (cuts - offsets[text] >= WINDOW) & ~np.isin(text, self.codec.odd_rows(data, offsets))
        cuts = cuts[fit]
        for _ in range(3):
            cuts = cuts + ((data[cuts] & 0xC0) == 0x80)
        return np.setdiff1d(cuts, offsets)

    def encode_all(self, parts: list[bytes]) -> list[Coded]:
        """Each part by itself, as if it were a text."""
        ids, offs = self.codec.encode(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
        letters, ends = self.decode(ids)
        letters, places = letters.tobytes(), np.concatenate([[0], ends])[offs].tolist()
        return [Coded(ids[a:b].copy(), (ends[a:b] - x).astype(np.int32), letters[x:y])
                for a, b, x, y in zip(offs.tolist(), offs[1:].tolist(), places, places[1:], strict=False)]

    def coded(self, parts: list[bytes]) -> list[Coded]:
        """The parts' encodings, from the store where this worker has met them."""
        if len(self.known) > self.capacity:
            self.known.clear()
        keys = [xxhash.xxh3_128_digest(part) for part in parts]
        new = {key: part for key, part in zip(keys, parts, strict=True) if key not in self.known}
        if new:
            self.known.update(zip(new, self.encode_all(list(new.values())), strict=True))
        return [self.known[key] for key in keys]

    def repaired(self, raw: bytes, offsets: np.ndarray, units: np.ndarray, bounds: np.ndarray, chunks: list[Coded], cuts: np.ndarray) -> list[tuple[int, int, Coded]]:
        """The ranges around the cuts, encoded anew until they agree with the chunks they end in."""
        text = np.searchsorted(offsets, cuts, "right") - 1
        bottom, top = np.searchsorted(units, offsets[text]).tolist(), np.searchsorted(units, offsets[text + 1]).tolist()
        lows = np.maximum(np.searchsorted(units, cuts, "right") - 2, bottom).tolist()
        highs = np.minimum(np.searchsorted(units, cuts, "left") + 1, top).tolist()
        left = (np.searchsorted(bounds, cuts) - 1).tolist()
        # A range: units from and to, the text's first and last, and the chunks it begins and ends in.
        done: dict[tuple, Coded] = {}
        ranges = list(zip(lows, highs, bottom, top, left, [c + 1 for c in left], strict=True))
        while any(r not in done for r in ranges):
            merged: list[tuple] = []
            for new in sorted(ranges):
                if merged and new[0] < merged[-1][1]:
                    old = merged.pop()
                    new = (old[0], max(old[1], new[1]), *old[2:5], max(old[5], new[5]))
                merged.append(new)
            ranges = [r for r in merged if r in done]
            wanted = [r for r in merged if r not in done]
            for r, own in zip(wanted, self.encode_all([raw[units[r[0]]:units[r[1]]] for r in wanted]), strict=True):
                lo, hi, b, t, c, d = r
                begins = lo == b or self.agree(own, units[lo], chunks[c], bounds[c], units[lo], units[lo + 1])
                ends = hi == t or self.agree(own, units[lo], chunks[d], bounds[d], units[hi - 1], units[hi])
                if begins and ends:
                    done[r] = own
                ranges.append((lo - (not begins), hi + (not ends), b, t, c, d))
        return [(int(units[r[0]]), int(units[r[1]]), done[r]) for r in sorted(ranges)]

    @staticmethod
    def agree(a: Coded, a_at: int, b: Coded, b_at: int, low: int, high: int) -> bool:
        """Whether two encodings that begin at ``a_at`` and ``b_at`` give the bytes between the same ids."""
        if low < b_at:
            return False
        x, y = a.rows(low - a_at, high - a_at), b.rows(low - b_at, high - b_at)
        return x is not None and y is not None and np.array_equal(a.ids[x[0]:x[1]], b.ids[y[0]:y[1]])

    def encode(self, data: np.ndarray, offsets: np.ndarray, mean: int = MEAN_CHUNK) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 16-bit numbers, decoded bytes) of each text of a slice."""
        raw, cuts = data.tobytes(), self.cuts(data, offsets, mean)
        bounds, units = np.union1d(offsets, cuts), np.union1d(self.codec.cut(data, offsets)[0], offsets)
        places = bounds.tolist()
        chunks = self.coded([raw[a:b] for a, b in zip(places, places[1:], strict=False)])
        ranges = self.repaired(raw, offsets, units, bounds, chunks, cuts) if len(cuts) else []
        made, r, c = [], 0, 0
        for low, high in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
            ids, letters, at = [], [], low
            while at < high:
                upto = ranges[r][0] if r < len(ranges) and ranges[r][0] < high else high
                if at < upto:
                    # Every cut lies in a range, so what lies between two is of one chunk.
                    while places[c + 1] <= at:
                        c += 1
                    base, chunk = places[c], chunks[c]
                    i, j = chunk.rows(at - base, upto - base)
                    ids.append(chunk.ids[i:j])
                    letters.append(chunk.letters[at - base:upto - base])
                at = upto
                if upto < high:
                    ids.append(ranges[r][2].ids)
                    letters.append(ranges[r][2].letters)
                    at, r = ranges[r][1], r + 1
            made.append((np.concatenate(ids).astype("<u2").tobytes() if ids else b"", b"".join(letters)))
        for row in self.codec.odd_rows(data, offsets).tolist():
            ids = self.codec.library.encode(raw[offsets[row]:offsets[row + 1]].decode("utf-8"), add_special_tokens=False).ids
            made[row] = np.array(ids, "<u2").tobytes(), self.codec.library.decode(ids, skip_special_tokens=False).encode("utf-8")
        return made


_chunks: dict[str, Chunks] = {}


def chunk_store(path: str) -> Chunks:
    codec = encoder(path)
    if path not in _chunks or _chunks[path].codec is not codec:
        _chunks.clear()
        _chunks[path] = Chunks(codec)
    return _chunks[path]


def encode(docs: DataFrame, vocabulary: str, mean: int = MEAN_CHUNK) -> DataFrame:
    """doc_id, ids (little-endian 16-bit), decoded (UTF-8), one row for each row of ``docs``.

    Null and empty texts have no ids; equal rows give equal rows; an empty table gives none.
    """

    def work(rows, data, offsets):
        made = chunk_store(vocabulary).encode(data, offsets, mean)
        return {"doc_id": rows.column("doc_id"), "ids": pa.array([m[0] for m in made], pa.binary()),
                "decoded": pa.array([m[1] for m in made], pa.binary())}

    return map_texts(texts(docs), "text", ENCODED, work)


def digests(docs: DataFrame, vocabulary: str, mean: int = MEAN_CHUNK) -> DataFrame:
    """Per document the number of ids and the digests of ids and of the decoded text."""

    def work(rows, data, offsets):
        made = chunk_store(vocabulary).encode(data, offsets, mean)
        wide = [np.frombuffer(ids, "<u2").astype("<u4").tobytes() for ids, _ in made]
        return {"doc_id": rows.column("doc_id"), "n_tokens": pa.array([len(w) // 4 for w in wide], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(w).hexdigest() for w in wide]),
                "decoded_sha256": pa.array([hashlib.sha256(m[1].decode("utf-8", "replace").encode()).hexdigest() for m in made])}

    return map_texts(texts(docs), "text", DIGESTS, work)
