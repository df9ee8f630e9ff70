"""Secret scans by one deterministic automaton for all rules.

Every rule's pattern is a bracketless subset of regular expressions that ends in a run of one
class. Its nondeterministic threads are kept in the order of their starts, so that the leftmost
match wins and takes as much as it can; once a thread has matched, later ones are dropped and
none starts until it ends. The product of these ordered sets over all rules is built by subset
construction, minimised by partition refinement, and laid out as one transition array over byte
classes. A text is scanned once, one array step a byte; where a match of some rule ends, its
start is found by running that rule's reversed automaton back, no further than the rule's match
before. Minimum lengths of rules that are a class alone are counted by the automaton, those of
the others when a match ends.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import map_documents, map_texts, texts

BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """``head`` then one or more of ``tail``; kept if the tail (``whole``: all of it) has ``least``."""

    kind: str
    head: str
    tail: str
    least: int
    whole: bool = False
    any_case: bool = False


#: The base rules (assign, access, hex) as given.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 12, any_case=True),
    Rule("access", r"AKIA", r"[A-Z0-9]", 18, whole=True),
    Rule("hex", r"", r"[0-9a-f]", 16),
    Rule("forge", r"gh[opsu]_", r"[A-Za-z0-9]", 36),
    Rule("chat", r"xox[abp]-", r"[A-Za-z0-9-]", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]", 10),
)


def parse(pattern: str, any_case: bool = False) -> list:
    """A sequence of items: a set of bytes, ("or", sequences), ("?" | "*" | "+", item)."""
    at = 0

    def one() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2:at], 16)
        return ord(c)

    def either_case(found: set[int]) -> frozenset[int]:
        return frozenset(found | {ord(chr(b).swapcase()) for b in found if chr(b).isascii() and chr(b).isalpha()} if any_case else found)

    def sequence() -> list:
        nonlocal at
        branches, items = [], []
        while at < len(pattern) and pattern[at] != ")":
            c = pattern[at]
            if c == "|":
                at += 1
                branches.append(items)
                items = []
                continue
            if c == "(":
                at += 1
                item = ("or", sequence())
                at += 1
            elif c == "[":
                at += 1
                found: set[int] = set()
                while pattern[at] != "]":
                    low = one()
                    if pattern[at] == "-" and pattern[at + 1] != "]":
                        at += 1
                        found.update(range(low, one() + 1))
                    else:
                        found.add(low)
                at += 1
                item = either_case(found)
            else:
                item = either_case({one()})
            if at < len(pattern) and pattern[at] in "?*+":
                item = (pattern[at], item)
                at += 1
            items.append(item)
        return [*branches, items]

    return sequence()


@dataclass
class Threads:
    """A rule's nondeterministic automaton: byte moves in order of preference, and free moves."""

    moves: list = field(default_factory=list)
    free: list = field(default_factory=list)

    def state(self) -> int:
        self.moves.append(None)
        self.free.append([])
        return len(self.moves) - 1

    def add(self, branches: list, start: int, reverse: bool) -> int:
        end = self.state()
        for items in branches:
            now = start
            for item in reversed(items) if reverse else items:
                now = self.item(item, now, reverse)
            self.free[now].append(end)
        return end

    def item(self, item, now: int, reverse: bool) -> int:
        if isinstance(item, frozenset):
            here, there = self.state(), self.state()
            self.free[now].append(here)
            self.moves[here] = (item, there)
            return there
        kind, inner = item
        if kind == "or":
            here = self.state()
            self.free[now].append(here)
            return self.add(inner, here, reverse)
        here, out = self.state(), self.state()
        self.free[now].append(here)
        end = self.item(inner, here, reverse)
        if kind in "*+":
            self.free[end].append(here)
        if kind in "?*":
            self.free[here].append(out)
        self.free[end].append(out)
        return out

    def close(self, states: tuple[int, ...]) -> tuple[int, ...]:
        """All states reached freely, in order of preference."""
        seen, out, stack = set(), [], list(reversed(states))
        while stack:
            s = stack.pop()
            if s not in seen:
                seen.add(s)
                out.append(s)
                stack.extend(reversed(self.free[s]))
        return tuple(s for s in out if self.moves[s] or not self.free[s])


def minimal(table: np.ndarray, output: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each state, one state of each class): states that no input can tell apart."""
    group = np.unique(output, axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([group[:, None], group[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            return finer, np.unique(finer, return_index=True)[1]
        group = finer


class Anchored:
    """A deterministic automaton that starts where it is told; for going back and for heads."""

    def __init__(self, branches: list, reverse: bool):
        nfa = Threads()
        first = nfa.state()
        last = nfa.add(branches, first, reverse)
        states, rows, todo = {nfa.close((first,)): 0}, [], [nfa.close((first,))]
        for now in todo:
            row = []
            for b in range(256):
                step = nfa.close(tuple(nfa.moves[s][1] for s in now if nfa.moves[s] and b in nfa.moves[s][0]))
                if step not in states:
                    states[step] = len(states)
                    todo.append(step)
                row.append(states[step])
            rows.append(row)
        self.table, self.accepts = rows, [last in s for s in todo]
        self.dead = states.get((), -1)

    def longest(self, data: Iterable[int]) -> int:
        """The length of the longest match at the front, or -1."""
        state, best = 0, 0 if self.accepts[0] else -1
        for i, b in enumerate(data, 1):
            state = self.table[state][b]
            if state == self.dead:
                break
            if self.accepts[state]:
                best = i
        return best


class Scanner:
    """The combined automaton of ``rules``."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.heads = [Anchored(parse(r.head, r.any_case), False) for r in rules]
        whole = [parse(f"({r.head}){r.tail}+", r.any_case) for r in rules]
        self.backs = [Anchored(w, True) for w in whole]
        threads, firsts, lasts = [], [], []
        for w in whole:
            nfa = Threads()
            firsts.append(nfa.state())
            lasts.append(nfa.add(w, firsts[-1], False))
            threads.append(nfa)
        counted = [r.least if not r.head else 0 for r in rules]
        sets = [s for nfa in threads for m in nfa.moves if m for s in [m[0]]]
        signature = np.array([[b in s for s in sets] for b in range(256)])
        _, example, letter = np.unique(signature, axis=0, return_index=True, return_inverse=True)
        self.letters = bytes(letter.ravel().astype(np.uint8))
        singles = [self.single(*x) for x in zip(threads, firsts, lasts, counted, [example.tolist()] * len(rules), strict=True)]
        # The product over the rules, as far as it can be reached.
        start = tuple(0 for _ in rules)
        states, todo, rows, ends = {start: 0}, [start], [], []
        for now in todo:
            row, out = [], []
            for c in range(len(example)):
                step = tuple(table[s][c][0] for table, s in zip(singles, now, strict=True))
                out.append(sum(1 << i for i, (table, s) in enumerate(zip(singles, now, strict=True)) if table[s][c][1]))
                if step not in states:
                    states[step] = len(states)
                    todo.append(step)
                row.append(states[step])
            rows.append(row)
            ends.append(out)
        table, ends = np.array(rows), np.array(ends)
        last = np.array([sum(1 << i for i, (t, s) in enumerate(zip(singles, now, strict=True)) if t[s][-1][1]) for now in todo])
        group, first = minimal(table, np.column_stack([ends, last]))
        self.width = len(example)
        self.table, self.ends, self.last = group[table[first]], ends[first], last[first]
        # One flat array: the next state's row, or the place of an event below zero.
        flat, self.events = (self.table * self.width).ravel(), []
        out = self.ends.ravel()
        flat = flat.tolist()
        for i in np.flatnonzero(out).tolist():
            self.events.append((flat[i], int(out[i])))
            flat[i] = -len(self.events)
        self.flat, self.start = flat, int(group[0]) * self.width

    @staticmethod
    def single(nfa: Threads, first: int, last: int, counted: int, letters: list[int]) -> list:
        """One rule's automaton without an anchor: per state and letter (next, match ends here)."""
        fresh = nfa.close((first,))

        def move(state, b):
            now, matched, count = state
            step = nfa.close(tuple(nfa.moves[s][1] for s in now if nfa.moves[s] and b in nfa.moves[s][0]))
            if matched and not step:  # the match is over; the byte may start another one
                after, ended = move((fresh, False, 0), b)
                return after, count >= counted
            if not matched:
                step = tuple(dict.fromkeys((*step, *fresh)))
            if last in step:  # what started later than the match is dropped
                return (step[:step.index(last) + 1], True, min(count + 1, counted)), False
            return (step, matched, count), False

        start = (fresh, False, 0)
        states, todo, rows = {start: 0}, [start], []
        for now in todo:
            row = []
            for b in letters:
                step, ended = move(now, b)
                if step not in states:
                    states[step] = len(states)
                    todo.append(step)
                row.append((states[step], ended))
            row.append((0, now[1] and now[2] >= counted))
            rows.append(row)
        return rows

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches kept, in bytes, by start and then by rule."""
        state, flat, found = self.start, self.flat, []
        closed = [0] * len(self.rules)
        for i, c in enumerate(data.translate(self.letters)):
            state = flat[state + c]
            if state < 0:
                state, kinds = self.events[-state - 1]
                self.close(data, i, kinds, closed, found)
        if kinds := int(self.last[state // self.width]):
            self.close(data, len(data), kinds, closed, found)
        found.sort()
        return found

    def close(self, data: bytes, end: int, kinds: int, closed: list[int], found: list) -> None:
        for k, rule in enumerate(self.rules):
            if kinds >> k & 1:
                length = self.backs[k].longest(data[i] for i in range(end - 1, closed[k] - 1, -1))
                start, closed[k] = end - length, end
                size = length if rule.whole else length - self.heads[k].longest(data[start:end])
                if size >= rule.least:
                    found.append((start, k, end))


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The worker's scanner of these rules; built once."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def in_letters(raw: bytes, places: list[int]) -> list[int]:
    """Ascending byte places as counts of code points."""
    out, at, done = [], 0, 0
    for p in places:
        done += len(raw[at:p].decode("utf-8", "ignore"))
        at = p
        out.append(done)
    return out


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text, spans): spans are (kind, start, end) in code points, by start and rule.

    Null and empty texts have none; equal rows are rows each; an empty table gives no rows.
    """
    made = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def work(rows, data, offsets):
        raw, bounds, out = data.tobytes(), offsets.tolist(), []
        for low, high in zip(bounds, bounds[1:], strict=False):
            text = raw[low:high]
            found = made.value.scan(text)
            places = sorted({p for s, _, e in found for p in (s, e)})
            at = dict(zip(places, in_letters(text, places), strict=True))
            out.append([{"kind": rules[k].kind, "start": at[s], "end": at[e]} for s, k, e in found])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return {"doc_id": rows.column("doc_id"), "text": rows.column("text"), "spans": pa.array(out, kind)}

    return map_texts(texts(docs), "text", "doc_id long, text string, spans array<struct<kind: string, start: long, end: long>>", work)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with ``mark`` in place of every secret; secrets that overlap are one.

    Null and empty texts stay as they are, every row stays, and so do all other columns.
    """
    made = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def work(rows, data, offsets):
        raw, bounds, out = data.tobytes(), offsets.tolist(), []
        for low, high in zip(bounds, bounds[1:], strict=False):
            text, parts, at = raw[low:high], [], 0
            for start, _, end in made.value.scan(text):
                if start >= at:
                    parts += [text[at:start].decode("utf-8"), mark]
                at = max(at, end)
            out.append("".join([*parts, text[at:].decode("utf-8")]) if parts else None)
        return None, out

    return map_documents(docs, work)


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document the counts of the base kinds, the digest of their spans, and all spans."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs, rules).select("doc_id", *map(count, BASE_KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
