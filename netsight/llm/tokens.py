"""Token ids of whole texts from public vocabularies, word by word, in numpy.

A text is cut at white space into units whose ids do not depend on their surroundings; every
unit is hashed in one pass over the bytes and looked up in a table of units met before in this
worker, so only new units meet the merge rules. The table is a cache: its size changes the time
alone. What the cut does not cover (strings of special tokens, letters beyond Latin-1, spaces
beyond ASCII, units with the byte that joins them) goes to the tokenizers library as it is.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from netsight.llm.common import SPACE, row_of, span_hashes, word_spans

CACHE_UNITS = 1 << 21
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_PLAIN = {"words": r"[!-~À-ÖØ-öø-ÿ]+", "bytes": r"[^\x01]+"}
#: The patterns by which the two vocabularies split a text.
#: The border byte between joined units splits off by itself.
_BORDER, _END = "\x01", "\x02"
BYTE_PATTERN = r"""\x01|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+(?![^\s\x01])|\s+"""
WORD_PATTERN = r"""\x01|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}\x01]+"""


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Units:
    """Open-addressing table from unit hashes to runs of ids, all in arrays."""

    def __init__(self, capacity: int = CACHE_UNITS):
        self.capacity, self.mask = capacity, (1 << (2 * capacity - 1).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.entry = np.full(self.mask + 1, -1, np.int32)
        self.start, self.count = np.zeros(self.capacity, np.int64), np.zeros(self.capacity, np.int32)
        self.pool = np.zeros(4 * self.capacity, np.uint16)

    def find(self, h: np.ndarray) -> np.ndarray:
        found, left = np.full(len(h), -1, np.int32), np.arange(len(h))
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            entry = self.entry[slot]
            same = (entry >= 0) & (self.keys[slot] == h[left])
            found[left[same]] = entry[same]
            on = (entry >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & self.mask
        return found

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct hashes that are not in the table, and at most as many as there is room for."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint16)])
        self.pool[self.used:self.used + len(ids)] = ids
        new = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.start[new], self.count[new] = self.used + np.cumsum(counts) - counts, counts
        self.used, self.n = self.used + len(ids), self.n + len(h)
        left, slot = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = new[left[free]]
            won = free & (self.entry[slot] == new[left])
            self.keys[slot[won]] = h[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask


class Encoder:
    """Encodes slices of texts. ``kind``: "bytes" keeps white space in the ids, "words" drops it."""

    def __init__(self, path: str, capacity: int = CACHE_UNITS):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model, letters = config["model"], byte_of_letter()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "words" if model.get("end_of_word_suffix") else "bytes"
        special = [t["content"] for t in config["added_tokens"]]
        self.special = [s.encode() for s in special]
        without = f"(?!(?s:.*)(?:{'|'.join(map(re.escape, special))}))" if special else ""
        self.plain = re.compile(without + _PLAIN[self.kind]).fullmatch
        self.units = Units(capacity)
        self.vocabulary: dict[int, bytes] = {}
        if self.kind == "bytes":
            ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
            self.core = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.vocabulary = {i: token for token, i in ranks.items()} | {t["id"]: t["content"].encode() for t in config["added_tokens"]}
            self.ids, self.border = np.arange(1 << 16, dtype=np.uint16), ranks[_BORDER.encode()]
            return
        # The end of a word is a byte that no plain unit holds; (byte, end) merges first of all.
        suffix, inverse, end = model["end_of_word_suffix"], {b: c for c, b in letters.items()}, _END.encode()
        ranks, ids = {}, {}
        for b in range(256):
            ranks[bytes([b])], ids[b] = b, model["vocab"][inverse[b]]
        for b in range(256):
            if bytes([b]) != end:
                ranks[bytes([b]) + end], ids[256 + b] = 256 + b, model["vocab"][inverse[b] + suffix]
        for i, merge in enumerate(model["merges"]):
            token = "".join(merge if isinstance(merge, list) else merge.split(" "))
            raw = bytes(letters[c] for c in token.removesuffix(suffix)) + end * token.endswith(suffix)
            if ranks.setdefault(raw, 512 + i) == 512 + i:
                ids[512 + i] = model["vocab"][token]
        self.core = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.zeros(max(ids) + 1, np.uint16)
        self.ids[list(ids)] = list(ids.values())
        self.pattern, self.border = regex.compile(WORD_PATTERN), ranks[_BORDER.encode() + end]

    def encode_units(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, counts): the ids of the units one after the other, in this order of theirs.

        Plain units are joined, so that the merging is one call; the rest follow one by one.
        """
        units = [unit.decode("utf-8") for unit in raw]
        plain = np.array([self.plain(text) is not None for text in units], bool)
        joined = _BORDER.join([text for text, ok in zip(units, plain, strict=True) if ok]) + _BORDER
        if self.kind == "words":
            joined = _END.join(self.pattern.findall(joined.lower())) + _END
        ranks = np.array(self.core.encode_ordinary(joined), np.int64)
        borders = np.flatnonzero(ranks == self.border)[:int(plain.sum())]
        parts, counts = [self.ids[ranks[ranks != self.border]]], [np.diff(borders, prepend=-1) - 1]
        odd = np.flatnonzero(~plain)
        for i in odd:
            ids = self.library.encode(units[i], add_special_tokens=False).ids
            parts.append(np.array(ids, np.uint16))
            counts.append(np.array([len(ids)]))
        return np.concatenate([np.flatnonzero(plain), odd]), np.concatenate(parts), np.concatenate(counts)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of the units, and which bytes belong to one."""
        if self.kind == "bytes":
            space = SPACE[data]
            first = np.zeros(len(data) + 1, bool)
            first[offsets[:-1]] = True
            first = first[:-1]
            first[1:] |= space[1:] & ~space[:-1]
            starts = np.flatnonzero(first)
            return starts, np.diff(np.append(starts, len(data))), np.ones(len(data), bool)
        return word_spans(data, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's texts (uint16), and where each text's ids begin."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(rows + 1, np.int64)
        starts, lengths, inside = self.cut(data, offsets)
        if len(starts):
            h = span_hashes(data, starts, lengths, inside)
            entry = self.units.find(h)
            missing = np.flatnonzero(entry < 0)
            if len(missing):
                new, first = np.unique(h[missing], return_index=True)
                if self.units.n + len(new) > self.units.capacity:
                    self.units.clear()
                    new, first = np.unique(h, return_index=True)
                    missing = np.arange(len(h))
                    if len(new) > self.units.capacity:
                        self.units = Units(2 * len(new))
                at = missing[first]
                raw = data.tobytes()
                order, ids, counts = self.encode_units([raw[s:e] for s, e in zip(starts[at].tolist(), (starts + lengths)[at].tolist(), strict=True)])
                self.units.add(new[order], ids, counts)
                entry[missing] = self.units.find(h[missing])
            counts = self.units.count[entry].astype(np.int64)
            ends = np.cumsum(counts)
            ids = self.units.pool[np.arange(ends[-1]) + np.repeat(self.units.start[entry] - (ends - counts), counts)]
            offs = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        else:
            ids, offs = np.zeros(0, np.uint16), np.zeros(rows + 1, np.int64)
        odd = self.odd_rows(data, offsets)
        if not len(odd):
            return ids, offs
        parts = np.split(ids, offs[1:-1])
        for row in odd:
            text = data[offsets[row]:offsets[row + 1]].tobytes().decode("utf-8")
            parts[row] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte-level texts in which white space alone does not tell where units may be cut."""
        if self.kind == "words":
            return np.zeros(0, np.int64)
        raw = data.tobytes()
        at = [m.start() for s in self.special if s in raw for m in re.finditer(re.escape(s), raw)]
        if any(lead in raw for lead in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")):
            at += [m.start() for m in _WIDE_SPACE.finditer(raw)]
        return np.unique(row_of(np.array(at, np.int64), offsets)) if at else np.zeros(0, np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary; one at a time is kept."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
