"""Text quality learned from trusted positives and unlabelled text alone.

Documents are described by counts over their whole text (kinds of characters, word lengths,
repetition), cut into quantile bins; the classifier is a sum of one weight per bin. It is
fitted by gradient descent on the non-negative unbiased risk of positive-unlabelled
learning (Kiryo et al., 2017)::

    prior * risk(positives as 1) + max(0, risk(unlabelled as 0) - prior * risk(positives as 0))

so that no negative label is ever used. The class prior is estimated first: a plain
classifier of positives against unlabelled text orders all documents, and the prior is the
smallest ratio between the share of all documents and the share of the positives above any
of its scores (Blanchard et al., 2010), counted over the whole corpus.

Bounds: the fit takes at most ``POSITIVES`` trusted rows and ``UNLABELLED`` others, chosen by a hash
of their id. Features, the prior's counts and scores cover every document.

Cases: a null or empty text has all counts zero and is scored like any other. Rows equal in
id and text share their score. Null ids are scored and never learned from; labels
that are null or contradict one another are left out. With no trusted positives every score is the prior, 0.5. An
empty table gives no scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, save
from .records import slices_of
from .wordhash import Words, shingles

POSITIVES, UNLABELLED = 6_000, 12_000
BINS, STEPS, RATE, DECAY = 16, 1_000, 0.05, 2e-5
#: positives that a threshold must leave above it to count for the prior
TAIL = 0.3
SCORE_BINS = 512
#: the ratio bounds the prior from above, so a little less than it is taken
BELOW = 0.98

_CLASS = np.zeros((8, 256))
for _row, _characters in enumerate((
    b"#*$%&|<>@^~=+_{}[]\\/", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"0123456789", b".,;:", b"\n", b"|",
    b"abcdefghijklmnopqrstuvwxyz",
)):
    _CLASS[_row, list(_characters)] = 1


def _shares(hits: np.ndarray, bounds: np.ndarray, less: int = 0) -> np.ndarray:
    """The share of each text's items (but for ``less`` of them) that are marked."""
    total = np.concatenate(([0], np.cumsum(hits)))
    n = np.diff(bounds) - less
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1)


def describe(texts: list[str]) -> np.ndarray:
    """The features of each text."""
    words = Words(texts, fold=False)
    n = len(texts)
    ends = words.text_starts[1:]
    owner = np.repeat(np.arange(n), np.diff(words.text_starts))
    count = np.bincount(owner * 256 + words.raw[words.text_starts[0] : ends[-1]], minlength=n * 256).reshape(n, 256)
    count[:, 32] -= 1  # what stands between the texts
    kinds = count @ _CLASS.T
    size = np.maximum(count.sum(axis=1), 1)
    characters = size - count[:, 0x80:0xC0].sum(axis=1)
    spaces = count[:, [9, 10, 11, 12, 13, 32]].sum(axis=1)
    n_words = np.diff(words.bounds)
    first = np.zeros(len(words), bool)
    first[words.bounds[:-1][n_words > 0]] = True
    same = np.zeros(len(words), bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    lengths = words.ends - words.starts
    grams, gram_bounds = shingles(words, 3)
    gram_owner = np.repeat(np.arange(n), np.diff(gram_bounds))
    order = np.lexsort((grams, gram_owner))
    again = np.zeros(len(grams), bool)
    again[1:] = (grams[order][1:] == grams[order][:-1]) & (gram_owner[order][1:] == gram_owner[order][:-1])
    p = count / size[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(p > 0, p * np.log2(p), 0).sum(axis=1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 7], 1)
    return np.column_stack([
        np.log1p(n_words), (characters - spaces) / np.maximum(n_words, 1), kinds[:, 0] / size,
        kinds[:, 1] / letters, kinds[:, 2] / size, kinds[:, 3] / size, kinds[:, 4] / np.maximum(n_words, 1),
        kinds[:, 5] / np.maximum(n_words, 1), kinds[:, 6] / np.maximum(n_words, 1),
        _shares(same & ~first, words.bounds, 1), _shares(again, gram_bounds), entropy,
        count[:, 0x80:].sum(axis=1) / size, _shares(lengths > 20, words.bounds), _shares(lengths == 1, words.bounds),
    ]).astype(np.float32)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table: ``_id, _tie, id`` and ``features`` of every row."""
    rows = keyed(docs, id_col, text_col).select("_id", "_tie", F.col(f"_row.{id_col}").alias("id"), "_text")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("_id", "id")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(3)
            for start, stop in slices_of(texts):
                found = describe(texts.slice(start, stop - start).to_pylist())
                head = batch.slice(start, stop - start)
                flat = pa.array(found.ravel(), pa.float32())
                lists = pa.FixedSizeListArray.from_arrays(flat, found.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [*(head.column(i) for i in range(3)), lists], names=["_id", "_tie", "id", "features"]
                )

    schema = f"_id {kinds[0]}, _tie long, id {kinds[1]}, features array<float>"
    return save(rows.mapInArrow(run, schema), "quality-features")


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The bin of each feature, as an index into the weights."""
        return np.column_stack([
            np.searchsorted(e, x[:, j], side="left") + j * (BINS + 1) for j, e in enumerate(self.edges)
        ])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.prior)
        return _sigmoid(self.weights[self.cells(x)].sum(axis=1) + self.weights[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    points = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(column, points)) for column in x.T]


def _descend(cells_p, cells_u, width: int, gradient) -> np.ndarray:
    """Adam on the weights of the bins (and the last one, of all)."""
    w, m, v = (np.zeros(width) for _ in range(3))
    for step in range(1, STEPS + 1):
        gp, gu = gradient(w[cells_p].sum(axis=1) + w[-1], w[cells_u].sum(axis=1) + w[-1])
        g = DECAY * w
        for cells, each in ((cells_p, gp), (cells_u, gu)):
            g += np.bincount(cells.ravel(), weights=np.repeat(each, cells.shape[1]), minlength=width)
            g[-1] += each.sum()
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def fit_plain(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Positives against unlabelled rows, each half of the weight."""
    model = Model(_edges(np.concatenate((positive, unlabelled))), np.empty(0), 0.5)
    width = len(model.edges) * (BINS + 1) + 1
    np_, nu = len(positive), len(unlabelled)
    model.weights = _descend(
        model.cells(positive), model.cells(unlabelled), width,
        lambda zp, zu: (-_sigmoid(-zp) / np_ / 2, _sigmoid(zu) / nu / 2),
    )
    return model


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    model = Model(_edges(np.concatenate((positive, unlabelled))), np.empty(0), prior)
    width = len(model.edges) * (BINS + 1) + 1
    np_, nu = len(positive), len(unlabelled)

    def gradient(zp, zu):
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp = -prior * _sigmoid(-zp) / np_
        if negative < 0:  # overfitted: step back from the part that fell below zero
            return prior * _sigmoid(zp) / np_, -_sigmoid(zu) / nu
        return gp - prior * _sigmoid(zp) / np_, _sigmoid(zu) / nu

    model.weights = _descend(model.cells(positive), model.cells(unlabelled), width, gradient)
    return model


def scored(table: DataFrame, model: Model) -> DataFrame:
    """``_id, _tie, id, score`` of every row of a feature table."""
    kinds = {c: table.schema[c].dataType.simpleString() for c in ("_id", "id")}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, len(model.edges)), np.float32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(model.scores(x), pa.float64())],
                names=["_id", "_tie", "id", "score"],
            )

    return table.mapInArrow(run, f"_id {kinds['_id']}, _tie long, id {kinds['id']}, score double")


def estimate_prior(table: DataFrame, plain: Model, positive: np.ndarray) -> float:
    """The share of positives among all documents."""
    bins = scored(table, plain).groupBy(F.floor(F.col("score") * SCORE_BINS).cast("int").alias("bin")).count()
    everyone = np.zeros(SCORE_BINS + 1)
    for row in bins.collect():  # as many rows as there are bins
        everyone[row["bin"]] += row["count"]
    own = np.bincount((plain.scores(positive) * SCORE_BINS).astype(int), minlength=SCORE_BINS + 1)
    above_all = np.cumsum(everyone[::-1]) / everyone.sum()
    above_own = np.cumsum(own[::-1]) / own.sum()
    enough = above_own >= TAIL
    return float(np.clip(BELOW * (above_all[enough] / above_own[enough]).min(), 0.05, 0.95))


def fit(
    table: DataFrame, trusted: DataFrame, may_learn: Column,
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Model:
    """The model from a feature table and ``trusted`` (``id`` of the positives).

    ``may_learn`` tells which rows' labels may be used; ``trusted`` must hold no others.
    """

    def sample(rows: DataFrame, most: int) -> np.ndarray:
        chosen = rows.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(7)), "_tie").limit(most)
        found = [r[0] for r in chosen.select("features").collect()]  # bounded by ``most``
        return np.array(found, np.float32)

    marked = table.where("id is not null").join(trusted.dropDuplicates(["id"]), "id", "left_semi")
    positive = sample(marked.where(may_learn), positives)
    others = sample(table.where("id is not null"), unlabelled)
    if not len(positive) or not len(others):
        return Model([], np.empty(0), 0.5)
    # one half of the positives teaches the order, the other half is counted in it
    taught, counted = positive[::2], positive[1::2] if len(positive) > 1 else positive
    prior = estimate_prior(table, fit_plain(taught, others), counted)
    return fit_non_negative(positive, others, prior)


def trusted_ids(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``id`` of the rows whose every label is 1."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("low")).where("low = 1").select("id")
