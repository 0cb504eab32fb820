"""Toxicity from bags of subword embeddings.

A word's vector is the mean of the embeddings of its character n-grams (3 to 6 bytes, its
ends marked) and of the word as a whole, so a spelling never seen before shares most of its vector with the word it
stands for. The vectors of a stretch of words are averaged and given to a linear softmax;
embeddings and softmax are trained jointly, by gradient descent in numpy. A document has the
probability of its worst stretch, so a few words count as much in a long text as in a
short one. Stretches overlap by half, so that a phrase lies whole in one of them. While training,
all stretches share the gradient by a soft maximum.

Bounds: the fit takes at most ``ROWS`` labelled rows of ``CHARACTERS`` characters together,
chosen by a hash of their id; a text that no longer fits is passed over. Every row is scored, by its whole text.

Cases: a null or empty text has no stretch and gets the share of toxic rows among those learned
from, as any text that tells nothing does. Rows equal in id and text share their score; null ids
are scored and never learned from. Labels that are null or contradict one another are
left out. Without labels of both kinds every score is the share of toxic rows (0 if there are no labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed
from .records import slices_of
from .wordhash import Words, mix

ROWS, CHARACTERS = 5_000, 20_000_000
BUCKETS, WIDTH, SIZES = 1 << 18, 8, (3, 4, 5, 6)
STRETCH = 8
#: labelled texts that a word must be in to be learned from
MIN_TEXTS = 3
STEPS, RATE, DECAY, SHARPNESS, SEED = 220, 0.1, 2e-5, 1.0, 5


def word_grams(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of some words and of their n-grams, with the white space on both sides as a mark."""
    raw, starts, ends = words.bytes, words.starts[which], words.ends[which]
    lengths = ends - starts + 2
    total = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(starts)), lengths)
    text = raw[np.repeat(starts - 1 - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)]
    text = np.where(text < 33, 32, text).astype(np.uint64) + np.uint64(1)
    found = [(mix(words.hashes[which]) % np.uint64(BUCKETS)).astype(np.int64)]
    whose = [np.arange(len(starts))]
    for n in SIZES:
        m = len(text) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + text[k : k + m]
        inside = owner[:m] == owner[n - 1 :]
        found.append((mix(h[inside]) % np.uint64(BUCKETS)).astype(np.int64))
        whose.append(owner[:m][inside])
    whose_all = np.concatenate(whose)
    order = np.argsort(whose_all, kind="stable")
    counts = np.bincount(whose_all, minlength=len(starts))
    return np.concatenate(found)[order], np.concatenate(([0], np.cumsum(counts)))


def spoken_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words of some texts, and the bounds of each text's: a word said
    several times in a row counts once."""
    head = np.zeros(len(words) + 1, bool)
    head[words.bounds[:-1]] = True
    said = head[:-1].copy()
    said[1:] |= words.hashes[1:] != words.hashes[:-1]
    return np.flatnonzero(said), np.concatenate(([0], np.cumsum(said)))[words.bounds]


def halves(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each half of a stretch of words begins, and the bounds of each text's halves."""
    pieces = -(-np.diff(bounds) // (STRETCH // 2))
    ends = np.concatenate(([0], np.cumsum(pieces)))
    within = np.arange(int(ends[-1])) - np.repeat(ends[:-1], pieces)
    return np.repeat(bounds[:-1], pieces) + within * (STRETCH // 2), ends


def partners(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The half that makes a stretch with each: the next, or the one before a text's last; and if there is one."""
    other = np.arange(1, int(bounds[-1]) + 1)
    some = np.diff(bounds) > 0
    last = bounds[1:][some] - 1
    other[last] = np.maximum(last - 1, bounds[:-1][some])
    return other, other != np.arange(len(other))


def _mean(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)


@dataclass
class Lesson:
    """Texts to learn from: stretches of words, and the n-grams of the words they share."""

    grams: np.ndarray  # bucket of each n-gram, word by word
    gram_bounds: np.ndarray
    words: np.ndarray  # of each text in turn: a row of ``gram_bounds``, or -1
    half_starts: np.ndarray  # positions in ``words``
    half_bounds: np.ndarray  # halves of stretches of each text


def lesson_of(texts: list[str], at_once: int = 200) -> Lesson:
    """Word hashes first; n-grams are made only of words in ``MIN_TEXTS`` texts or more.

    A word of one or two texts teaches nothing but these texts: it counts as a zero vector.
    """
    hashes, bounds = [], [np.zeros(1, np.int64)]
    for at in range(0, len(texts), at_once):
        words = Words(texts[at : at + at_once])
        spoken, edges = spoken_words(words)
        hashes.append(words.hashes[spoken])
        bounds.append(edges[1:] + bounds[-1][-1])
    said, edges = np.concatenate(hashes), np.concatenate(bounds)
    del hashes
    names, which = np.unique(said, return_inverse=True)
    which = which.astype(np.int32)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(edges))
    pairs = np.unique(text_of * max(len(names), 1) + which)
    common = np.bincount(pairs % max(len(names), 1), minlength=len(names)) >= MIN_TEXTS
    row = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
    del said, text_of, pairs
    wanted, missing = names[common], np.ones(int(common.sum()), bool)
    found, counts = [], np.zeros(len(wanted), np.int64)
    order = []
    for at in range(0, len(texts), at_once):
        words = Words(texts[at : at + at_once])
        here, first = np.unique(words.hashes, return_index=True)
        place = np.minimum(np.searchsorted(wanted, here), max(len(wanted) - 1, 0))
        new = np.flatnonzero((wanted[place] == here) & missing[place]) if len(wanted) else np.empty(0, np.int64)
        if len(new):
            grams, ends = word_grams(words, first[new])
            found.append(grams.astype(np.int32))
            order.append(place[new])
            counts[place[new]] = np.diff(ends)
            missing[place[new]] = False
    # words came in the order of the texts; put their n-grams in the order of their rows
    if found:
        came = np.concatenate(order)
        flat = np.concatenate(found)
        starts = np.concatenate(([0], np.cumsum(counts[came])))[:-1]
        begin = np.empty(len(wanted), np.int64)
        begin[came] = starts
        ends = np.cumsum(counts)
        flat = flat[np.repeat(begin - (ends - counts), counts) + np.arange(int(ends[-1]))]
    else:
        flat, ends = np.empty(0, np.int32), np.empty(0, np.int64)
    starts, half_bounds = halves(edges)
    return Lesson(flat, np.concatenate(([0], ends)).astype(np.int64), row[which], starts, half_bounds)


@dataclass
class Model:
    """``logits`` of each n-gram: embeddings times the difference of the softmax's rows."""

    logits: np.ndarray
    bias: float
    share: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.share)
        words = Words(texts)
        if not len(self.logits) or not len(words):
            return out
        spoken, bounds = spoken_words(words)
        _, first, which = np.unique(words.hashes[spoken], return_index=True, return_inverse=True)
        first = spoken[first]
        grams, gram_bounds = word_grams(words, first)
        each = _mean(self.logits[grams], gram_bounds)[which]
        starts, half_bounds = halves(bounds)
        other, joined = partners(half_bounds)
        total, n = np.add.reduceat(each, starts), np.diff(np.append(starts, len(each)))
        level = (total + joined * total[other]) / (n + joined * n[other]) + self.bias
        some = np.diff(half_bounds) > 0
        worst = np.maximum.reduceat(level, half_bounds[:-1][some])
        out[some] = 1 / (1 + np.exp(-np.clip(worst, -40, 40)))
        return out


def fit_lesson(lesson: Lesson, toxic: np.ndarray, steps: int = STEPS) -> Model:
    """Train embeddings and softmax together, all rows in every step (Adam)."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0) or len(lesson.gram_bounds) < 2:
        return Model(np.empty(0, np.float32), 0.0, share)
    rng = np.random.default_rng(SEED)
    kept = np.flatnonzero(lesson.words >= 0)
    own = lesson.words[kept]
    gram_bounds = lesson.gram_bounds
    used, grams = np.unique(lesson.grams, return_inverse=True)
    grams = grams.astype(np.int32)
    word_ends = np.append(lesson.half_starts, len(lesson.words))
    other, joined = partners(lesson.half_bounds)
    half_n = np.diff(word_ends)
    stretch_n = half_n + joined * half_n[other]
    half_of = np.repeat(np.arange(len(half_n), dtype=np.int32), half_n)[kept]
    del kept
    gram_n = np.maximum(np.diff(gram_bounds), 1)
    texts = np.repeat(np.arange(len(toxic)), np.diff(lesson.half_bounds))
    some = np.flatnonzero(np.diff(lesson.half_bounds) > 0)
    heads = lesson.half_bounds[:-1][some]
    values = [
        rng.normal(0, 0.1, (len(used), WIDTH)).astype(np.float32),  # embeddings
        rng.normal(0, 0.5, (2, WIDTH)).astype(np.float32),  # softmax
        np.array([0.0, np.log(share / (1 - share))], np.float32),  # its bias
    ]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in values]
    for step in range(1, steps + 1):
        embedding, softmax, bias = values
        slope = softmax[1] - softmax[0]
        words = _mean((embedding @ slope)[grams], gram_bounds)
        total = np.bincount(half_of, weights=words[own], minlength=len(half_n))
        z = (total + joined * total[other]) / stretch_n + (bias[1] - bias[0])
        # soft maximum over a text's stretches, and each stretch's share of its gradient
        top = np.zeros(len(toxic))
        top[some] = np.maximum.reduceat(z, heads)
        weight = np.exp(SHARPNESS * (z - top[texts]))
        total = np.bincount(texts, weights=weight, minlength=len(toxic))
        weight /= total[texts]
        level = np.bincount(texts, weights=weight * z, minlength=len(toxic))
        p = 1 / (1 + np.exp(-np.clip(level, -40, 40)))
        gz = ((p - toxic) / len(some))[texts] * weight
        on_halves = gz / stretch_n
        on_halves += np.bincount(other, weights=joined * on_halves, minlength=len(half_n))
        on_words = np.bincount(own, weights=on_halves[half_of], minlength=len(words))
        on_grams = np.bincount(grams, weights=np.repeat(on_words / gram_n, gram_n), minlength=len(used))
        g_slope = on_grams @ embedding
        gradients = [
            np.outer(on_grams.astype(np.float32), slope) + np.float32(DECAY) * embedding,
            np.stack((-g_slope, g_slope)).astype(np.float32),
            np.array([-gz.sum(), gz.sum()], np.float32),
        ]
        for x, g, (m, v) in zip(values, gradients, moments):
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            v *= np.float32(0.99)
            v += np.float32(0.01) * g
            np.sqrt(v, out=g)
            g *= np.float32(1 / np.sqrt(1 - 0.99**step))
            g += np.float32(1e-8)
            x -= np.float32(RATE / (1 - 0.9**step)) * m / g
    logits = np.zeros(BUCKETS, np.float32)
    logits[used] = values[0] @ (values[1][1] - values[1][0])
    return Model(logits, float(values[2][1] - values[2][0]), share)


def fit(
    docs: DataFrame, toxic: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    rows: int = ROWS, characters: int = CHARACTERS,
) -> Model:
    """The model from the documents that ``toxic`` (``id``, ``label``) names."""
    known = keyed(docs, id_col, text_col).select(F.col(f"_row.{id_col}").alias("id"), "_tie", "_text")
    # chosen by narrow rows; texts are then read where they lie, for the chosen rows alone
    labelled = known.select("id", "_tie", F.length("_text").alias("n")).join(toxic, "id").distinct()
    order = [F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.col("id"), F.col("_tie")]
    picked, size = [], 0
    for r in labelled.orderBy(*order).limit(rows).collect():
        if size + r["n"] > characters:
            continue
        size += r["n"]
        picked.append((r["id"], r["_tie"], r["label"]))
    if not picked:
        return Model(np.empty(0, np.float32), 0.0, 0.0)
    few = docs.sparkSession.createDataFrame(picked, labelled.select("id", "_tie", "label").schema)
    taken = known.join(F.broadcast(few), ["id", "_tie"]).select("id", "_tie", "_text", "label")
    texts = {(r["id"], r["_tie"]): (r["_text"], r["label"]) for r in taken.collect()}  # at most ``characters``
    chosen = [texts[k] for k in sorted(texts)]
    return fit_lesson(lesson_of([t for t, _ in chosen]), np.array([y for _, y in chosen], float))


def toxic_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``id, label`` of the rows whose labels agree."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return (
        known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("high"))
        .where("label = high").select("id", "label")
    )


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in slices_of(batch.column(1)):
                head = batch.slice(start, stop - start)
                found = sent.value.scores(head.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([head.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {kind}, score double")
