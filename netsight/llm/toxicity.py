"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed into one table of embeddings, as wholes (twice, so that words that share one row
still differ) and by their stems, and the rows added. Filters of several widths run over the words, each filter's largest
answer is kept (max pooling), and a logistic layer weighs these. Training is by back-propagation
over mini-batches. A separate part of the labelled rows turns the output into a probability
(Platt scaling, with the class shares of all labelled rows) and gives each language the threshold
with the best F1; languages with few toxic rows take the threshold of all.

The text alone makes the score; ``lang`` only picks the threshold. Every labelled row that is not
held out takes part, with its whole text. In a round each learner, a task, goes through its share
of the rows from the model of the round before; their changes are averaged by ranges of the table,
each row of it by how much its learners had to say. The rows that calibrate are counted by output,
in steps of 1/``GRID``, and language. Only the model and these counts, of fixed size, reach the
driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import SLICE_BYTES, map_documents, map_texts, mixed, shared, slices, small_batches, span_hashes, text_bytes, word_spans

ROWS = 1 << 17
DIM = 12
WIDTHS = (1, 2, 3)
STEMS = (4, 5, 6)
PER_WORD = 2 + len(STEMS)
FILTERS = 8
EPOCHS, MOST_EPOCHS, STEPS = 6, 40, 420
ROUNDS, LEARNER_ROWS = 3, 8192
BATCH = 64
HELD_WORDS, HEAD, LEARN_BYTES = 4 << 20, 16, 512 << 10
WINDOWS = 1 << 13
PART = 1 << 11
GRID, MOST_OUTPUT = 1024, 64
FEWEST = 20
SCORE_BYTES, SCORE_WORDS = 128 << 10, 1 << 14
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _low, _high, _to in ((0x30, 0x39, 0x30), (0x41, 0x5A, 0x61), (0x61, 0x7A, 0x61)):
    _FOLD[_low:_high + 1] = np.arange(_to, _to + _high - _low + 1)


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the table rows of each word, where each text's words begin).

    A word is a run of letters, digits or bytes beyond ASCII; letters A-Z count as a-z. Two rows
    stand for the word, one each for its first ``STEMS`` bytes, so that inflected forms meet.
    """
    starts, lengths, inside = word_spans(folded := _FOLD[data], offsets)
    h = span_hashes(folded, starts, lengths, inside)
    rows, stem = [h, h >> np.uint64(32)], np.zeros(len(starts), np.uint64)
    padded = np.append(folded, np.zeros(max(STEMS), np.uint8))
    for i in range(max(STEMS)):
        stem |= np.where(lengths > i, padded[starts + i], 0).astype(np.uint64) << np.uint64(8 * i)
        if i + 1 in STEMS:
            rows.append(mixed(stem + np.uint64(i)))
    rows = np.column_stack([r & np.uint64(ROWS - 1) for r in rows])
    return rows.astype(np.int32), np.searchsorted(starts, offsets)


DENSE = ("filters", "bias", "weights")


@dataclass
class Model:
    table: np.ndarray  # ROWS + 1 embeddings; the last is zero, for padding
    filters: np.ndarray  # DIM x (a column for each width, place and filter)
    bias: np.ndarray
    weights: np.ndarray
    offset: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict | None = None

    @staticmethod
    def new(seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        table = (rng.standard_normal((ROWS + 1, DIM)) * 0.05).astype(np.float32)
        table[-1] = 0
        return Model(table, (rng.standard_normal((DIM, sum(WIDTHS) * FILTERS)) / np.sqrt(DIM)).astype(np.float32),
                     np.zeros(len(WIDTHS) * FILTERS, np.float32), (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32))

    def padded(self, rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, first place of each text).

        A zero vector stands before each text and two behind it, so every filter answers at least once.
        """
        n = len(places) - 1
        pad = np.full((3 * n + len(rows), PER_WORD), ROWS, np.int32)
        firsts = places[:-1] + 3 * np.arange(n)
        pad[np.arange(len(rows)) + 1 + 3 * np.repeat(np.arange(n), np.diff(places))] = rows
        return pad, firsts

    def answers(self, pad: np.ndarray) -> np.ndarray:
        """Filter answers at each place but the last two."""
        x = self.table[pad[:, 0]]
        for i in range(1, PER_WORD):
            x += self.table[pad[:, i]]
        z = x @ self.filters
        out = np.empty((max(0, len(pad) - 2), len(WIDTHS) * FILTERS), np.float32)
        at = 0
        for w, width in enumerate(WIDTHS):
            own = out[:, w * FILTERS:(w + 1) * FILTERS]
            own[:] = z[:len(out), at * FILTERS:(at + 1) * FILTERS]
            for o in range(1, width):
                own += z[o:len(out) + o, (at + o) * FILTERS:(at + o + 1) * FILTERS]
            at += width
        return out + self.bias

    def tops(self, rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest answer of each text and filter, the table rows of the words it was given at)."""
        pad, firsts = self.padded(rows, places)
        ends = np.append(firsts[1:], len(pad)) - 2
        best = np.full((len(firsts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        spot, every = np.zeros(best.shape, np.int64), np.arange(best.shape[1])
        for low in range(0, len(pad) - 2, WINDOWS):
            out = self.answers(pad[low:low + WINDOWS + 2])
            for i in range(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(firsts, low + len(out)))):
                own = out[max(firsts[i] - low, 0):ends[i] - low]
                if len(own):
                    top = own.argmax(0)
                    more = own[top, every] > best[i]
                    best[i, more] = own[top, every][more]
                    spot[i, more] = top[more] + max(firsts[i], low)
        return best, pad[spot[:, :, None] + np.arange(max(WIDTHS))]

    def outputs(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The logistic layer's answer for each text, before scaling."""
        if len(places) < 2:
            return np.zeros(0, np.float64)
        pad, firsts = self.padded(rows, places)
        answers = self.answers(pad)
        # The two places before the next text's first mix both texts; they do not count.
        seams = (np.concatenate([firsts[1:], [len(answers)]])[:-1, None] - np.array([2, 1])).ravel()
        answers[seams] = -np.inf
        pooled = np.maximum(np.maximum.reduceat(answers, firsts), 0)
        return (pooled @ self.weights + self.offset).astype(np.float64)

    def scores(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.outputs(rows, places) * self.scale + self.shift, -500, 500)))

    def judge(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, threshold of the row's language) of each text of a slice."""
        made = [np.zeros(0)]
        for low, high in slices(offsets, SCORE_BYTES):
            made.append(self.scores(*word_rows(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])))
        bars = [self.thresholds.get(x, self.thresholds[None]) for x in rows.column("lang").to_pylist()]
        return np.concatenate(made), np.array(bars, np.float64)


def epochs_for(rows: int) -> int:
    """Few rows are gone through more often, for about ``STEPS`` steps in all."""
    return max(EPOCHS, min(MOST_EPOCHS, -(-STEPS * BATCH // max(1, rows))))


def class_weights(counts: dict) -> np.ndarray:
    """What a row of either class weighs, so that both classes weigh the same."""
    return np.array([1 / max(1, 2 * counts.get(c, 0)) for c in (0, 1)]) * sum(counts.values())


def train(texts: list[np.ndarray], toxic: np.ndarray, epochs: int | None = None, seed: int = 11) -> Model:
    """A model fitted to word rows of texts and their labels, both classes weighing the same."""
    model = Model.new(seed)
    counts = {c: int((toxic == c).sum()) for c in (0, 1)}
    Learner(model, np.zeros(ROWS + 1, np.float32), class_weights(counts), seed).learn(texts, toxic, epochs or epochs_for(len(texts)))
    return model


class Learner:
    """Back-propagation into ``model`` and ``seen``, the squared changes of its table's rows so far."""

    def __init__(self, model: Model, seen: np.ndarray, share: np.ndarray, seed: int):
        self.model, self.seen, self.share, self.rng, self.step = model, seen, share, np.random.default_rng(seed), 0
        self.dense = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in DENSE}

    def learn(self, texts: list[np.ndarray], toxic: np.ndarray, epochs: int) -> None:
        for _ in range(epochs):
            order = self.rng.permutation(len(texts))
            for low in range(0, len(order), BATCH):
                own = order[low:low + BATCH]
                self.batch([texts[i] for i in own], toxic[own])

    def batch(self, texts: list[np.ndarray], toxic: np.ndarray) -> None:
        model = self.model
        best, near = model.tops(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
        pooled = np.maximum(best, 0)
        z = pooled @ model.weights + model.offset
        slope = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) * self.share[toxic] / len(texts)
        grads = {"weights": pooled.T @ slope + 1e-4 * model.weights}
        back = slope[:, None] * model.weights * (pooled > 0)
        grads["bias"] = back.sum(0)
        grads["filters"] = np.zeros_like(model.filters)
        rows, vectors = [], []
        at = 0
        for w, width in enumerate(WIDTHS):
            cols = slice(w * FILTERS, (w + 1) * FILTERS)
            d = back[:, cols]
            b, f = np.nonzero(d)
            for o in range(width):
                own_filters = slice((at + o) * FILTERS, (at + o + 1) * FILTERS)
                grads["filters"][:, own_filters] = np.einsum("bfd,bf->df", model.table[near[:, cols, o]].sum(2), d)
                rows.append(near[b, f + w * FILTERS, o])
                vectors.append(d[b, f][:, None] * model.filters[:, own_filters].T[f])
            at += width
        rows, inverse = np.unique(np.concatenate(rows).ravel(), return_inverse=True)
        change = np.zeros((len(rows), DIM), np.float32)
        np.add.at(change, inverse.ravel(), np.repeat(np.concatenate(vectors), PER_WORD, axis=0).astype(np.float32))
        change[rows == ROWS] = 0
        self.seen[rows] += (change ** 2).mean(1)
        model.table[rows] -= 0.1 * change / (np.sqrt(self.seen[rows]) + 1e-6)[:, None]
        self.step += 1
        for name, g in grads.items():
            m, v = self.dense[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            getattr(model, name)[...] -= 0.01 * (m / (1 - 0.9 ** self.step)) / (np.sqrt(v / (1 - 0.99 ** self.step)) + 1e-8)
        model.offset -= 0.05 * float(slope.sum())


def calibrate(model: Model, z: np.ndarray, toxic: np.ndarray, langs: list, weight: np.ndarray) -> None:
    """Scale outputs to probabilities and set the thresholds of all and of the languages that ``langs`` names."""
    a, b = 1.0, 0.0
    target = np.where(toxic == 1, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
    model.scale, model.shift = max(a, 1e-3), b
    scores = 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -500, 500)))

    def best(own: np.ndarray) -> float:
        order = np.argsort(-scores[own], kind="stable")
        s, t, w = scores[own][order], toxic[own][order], weight[own][order]
        hits = np.cumsum(w * (t == 1))
        f1 = 2 * hits / (np.cumsum(w) + max(1e-12, float((w * (t == 1)).sum())))
        top = int(np.argmax(np.where(np.diff(s, append=-1) != 0, f1, -1)))
        return float((s[top] + (s[top + 1] if top + 1 < len(s) else 0.0)) / 2)

    langs = np.array([x or "" for x in langs], object)
    model.thresholds = {None: best(np.arange(len(z)))}
    for lang in set(langs.tolist()) - {""}:
        model.thresholds[lang] = best(np.flatnonzero(langs == lang))


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """(text, lang, toxic, tune) of all labelled rows that are not held out, and how many labels of either class there are."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(fold != 0))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # Both sides are shuffled at any size, so that no label table has to fit one task; held-out texts stay where they are.
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
            .where(fold != 0).join(known.hint("merge"), "doc_id").select("text", "lang", F.col("toxic").cast("int").alias("toxic"), (fold == 1).alias("tune")))
    return shared(rows, "labelled"), counts


def hashed_texts(batches, size: int = SLICE_BYTES):
    """(rows of a slice, word rows of each of its texts)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for low, high in slices(offsets, size):
            w, places = word_rows(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            yield batch.slice(low, high - low), [w[a:b] for a, b in zip(places, places[1:], strict=False)]


class Held:
    """Word rows of texts and their classes, in one array of ``room`` words that goes back to the system as a whole.

    Workers live on, and many arrays of middling size would stay with them: freed, but in pieces.
    """

    def __init__(self, room: int):
        self.store, self.ends, self.classes = np.empty((room, PER_WORD), np.int32), [0], []

    def takes(self, text: np.ndarray) -> bool:
        return self.ends[-1] + len(text) <= HELD_WORDS

    def add(self, text: np.ndarray, toxic: int) -> None:
        self.store[self.ends[-1]:self.ends[-1] + len(text)] = text
        self.ends.append(self.ends[-1] + len(text))
        self.classes.append(toxic)

    def ordered(self) -> tuple[list[np.ndarray], np.ndarray]:
        """(texts, classes) by class and then by the bytes of the text, of which only beginnings are copied if they differ."""
        texts = [self.store[a:b] for a, b in zip(self.ends, self.ends[1:], strict=False)]
        head = lambda i: (self.classes[i], texts[i][:HEAD].tobytes())
        order = []
        for _, alike in groupby(sorted(range(len(texts)), key=head), head):
            own = list(alike)
            order += own if len(own) == 1 else sorted(own, key=lambda i: texts[i].tobytes())
        return [texts[i] for i in order], np.array(self.classes)[order]


def learnt(rows: DataFrame, model: Model, seen: np.ndarray, share: np.ndarray, epochs: int, learners: int) -> tuple[Model, np.ndarray]:
    """The model after a round over all ``rows`` (text, toxic), and the squared changes of its table's rows.

    A learner holds up to ``HELD_WORDS`` words at a time and goes through these ``epochs`` times.
    """
    given = rows.sparkSession.sparkContext.broadcast((model, seen))

    def work(batches):
        first, first_seen = given.value
        own = replace(first, **{k: getattr(first, k).copy() for k in ("table", *DENSE)})
        learner = Learner(own, first_seen.copy(), share, 11)
        held, learned = Held(HELD_WORDS), 0
        for batch, texts in hashed_texts(batches, LEARN_BYTES):
            for text, toxic in zip(texts, batch.column("toxic").to_pylist(), strict=True):
                if not held.takes(text):
                    if held.classes:
                        learner.learn(*held.ordered(), epochs)
                    held = Held(max(HELD_WORDS, len(text)))
                held.add(text, toxic)
                learned += 1
        if held.classes:
            learner.learn(*held.ordered(), epochs)
        if not learned:
            return
        more = learner.seen - first_seen
        flat = lambda m: np.concatenate([*(getattr(m, k).ravel() for k in DENSE), [m.offset]]).astype(np.float32)
        out = [(-1, b"", (flat(own) - flat(first)).tobytes(), np.array([learned], np.float32).tobytes())]
        for low in range(0, ROWS, PART):
            at = low + np.flatnonzero(more[low:min(low + PART, ROWS)])
            out.append((low, at.astype(np.int32).tobytes(), (own.table[at] - first.table[at]).tobytes(), more[at].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                                         ["part", "place", "change", "seen"])

    def merged(found: pa.Table) -> pa.Table:
        part = found.column("part")[0].as_py()
        changes = [(np.frombuffer(r["place"], np.int32), np.frombuffer(r["change"], np.float32), np.frombuffer(r["seen"], np.float32)) for r in found.to_pylist()]
        if part < 0:
            total = np.array([sum(float(n[0]) for _, _, n in changes)], np.float32)
            place, change = np.zeros(0, np.int32), sum(c.astype(np.float64) * (float(n[0]) / float(total[0])) for _, c, n in changes)
        else:
            all_change, mass, said = np.zeros((PART, DIM)), np.zeros(PART), np.zeros(PART)
            for at, c, n in changes:
                all_change[at - part] += c.reshape(-1, DIM) * n[:, None].astype(np.float64)
                mass[at - part] += n
                said[at - part] += 1
            own = np.flatnonzero(mass)
            place, change, total = (own + part).astype(np.int32), all_change[own] / mass[own, None], (mass[own] / said[own]).astype(np.float32)
        return pa.table({"part": pa.array([part], pa.int32()), "place": [place.tobytes()], "change": [change.astype(np.float32).tobytes()], "seen": [total.tobytes()]})

    schema = "part int, place binary, change binary, seen binary"
    model, seen = replace(model, **{k: getattr(model, k).copy() for k in ("table", *DENSE)}), seen.copy()
    with small_batches(rows.sparkSession):
        made = rows.coalesce(learners).mapInArrow(work, schema).groupBy("part").applyInArrow(merged, schema).collect()
    for r in made:
        change = np.frombuffer(r["change"], np.float32)
        if r["part"] < 0:
            for k in DENSE:
                own = getattr(model, k)
                own += change[:own.size].reshape(own.shape)
                change = change[own.size:]
            model.offset += float(change[0])
        else:
            at = np.frombuffer(r["place"], np.int32)
            model.table[at] += change.reshape(-1, DIM)
            seen[at] += np.frombuffer(r["seen"], np.float32)
    given.destroy()
    return model, seen


def outputs_counted(rows: DataFrame, model: Model) -> DataFrame:
    """(lang, toxic, z, n): how many of ``rows`` have an output in a step of the grid; of languages with few rows of a class, lang is null."""
    given = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch, texts in hashed_texts(batches):
            places, z = np.cumsum([0, *map(len, texts)]), []
            for low, high in slices(places, SCORE_WORDS):
                z.append(given.value.outputs(np.concatenate(texts[low:high]), places[low:high + 1] - places[low]))
            z = np.clip(np.concatenate(z), -MOST_OUTPUT, MOST_OUTPUT)
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "toxic": batch.column("toxic"),
                                              "z": pa.array(np.rint(z * GRID).astype(np.int64))})

    per = rows.groupBy("lang").agg(F.count_if(F.col("toxic") == 0).alias("a"), F.count_if(F.col("toxic") == 1).alias("b"))
    known = [r["lang"] for r in per.where(f"lang <> '' and a >= {FEWEST} and b >= {FEWEST}").select("lang").collect()]
    lang = F.when(F.col("lang").isin(known), F.col("lang"))
    return (rows.mapInArrow(work, "lang string, toxic int, z long").groupBy(lang.alias("lang"), "toxic", "z")
            .agg(F.count("*").alias("n")))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from all rows whose crc32 of the doc_id is not divisible by 5; a fourth of these calibrates.

    Without rows of both classes the model answers the share of the toxic ones everywhere.
    """
    rows, counts = labelled(docs, labels)
    total = max(1, sum(counts.values()))
    constant = Model.new()
    constant.weights[:] = 0
    share = np.clip(counts.get(1, 0) / total, 1e-6, 1 - 1e-6)
    constant.shift, constant.thresholds = float(np.log(share / (1 - share))), {None: 0.5}
    found = {(r["tune"], r["toxic"]): r["count"] for r in rows.groupBy("tune", "toxic").count().collect()}
    if len(found) < 4:
        return constant
    learn = {c: found[False, c] for c in (0, 1)}
    n = sum(learn.values())
    learners = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, n // LEARNER_ROWS))
    rounds = 1 if learners == 1 else ROUNDS
    model, seen = Model.new(), np.zeros(ROWS + 1, np.float32)
    for _ in range(rounds):
        model, seen = learnt(rows.where("not tune").select("text", "toxic"), model, seen, class_weights(learn),
                             -(-epochs_for(n // learners) // rounds), learners)
    steps = sorted(outputs_counted(rows.where("tune"), model).collect(), key=lambda r: (r["z"], r["toxic"], r["lang"] or ""))
    toxic, own = np.array([r["toxic"] for r in steps]), np.array([r["n"] for r in steps], np.float64)
    tune = sum(own)
    weight = np.array([counts[c] / total / found[True, c] for c in (0, 1)])[toxic] * tune * own
    calibrate(model, np.array([r["z"] for r in steps]) / GRID, toxic, [r["lang"] for r in steps], weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` rows as doc_id, held_out, score, predicted, threshold, rejected.

    Null and empty texts are scored like any other, by what the filters answer to nothing; a null
    doc_id is not held out; a null or unknown lang takes the threshold of all.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def work(rows, data, offsets):
        scores, bars = shared_model.value.judge(rows, data, offsets)
        return {"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "score": pa.array(scores),
                "predicted": pa.array((scores >= 0.5).astype(np.int32)), "threshold": pa.array(bars), "rejected": pa.array(scores >= bars)}

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"),
                       F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return map_texts(rows, "text", "doc_id long, held_out boolean, score double, predicted int, threshold double, rejected boolean", work)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, as they are, whose score is below their language's threshold.

    Null and empty texts are judged by what the filters answer to nothing, equal rows each alike;
    other columns play no part. An empty table gives no rows.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def work(rows, data, offsets):
        scores, bars = shared_model.value.judge(rows, data, offsets)
        return scores < bars, None

    return map_documents(docs, work)
