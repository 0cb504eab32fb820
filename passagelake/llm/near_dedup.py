"""Near duplicates by weighted Jaccard similarity of five-word shingles.

1. A first pass counts in how many documents each shingle occurs, into a count sketch of
   fixed size whose counters add up; its counts give every shingle its inverse document
   frequency. A shingle's weight is the root of that times its count in the document: with the
   full frequency, rare edits of a text with very many copies outweigh what they share.
2. A second pass draws ``HASHES`` samples of each document's weights by improved consistent
   weighted sampling (Ioffe, 2010): two documents draw the same sample with the probability of
   their weighted Jaccard similarity. Five samples make a band. As many unweighted samples (the
   smallest hashes) make further bands, for pairs whose plain similarity is the higher one.
   Documents of the same words are one node from here on, copies are never compared.
3. Star rounds: each node meets the first node of one of its buckets, and when links have become
   classes, that of one of its buckets whose first node is in another class. Rounds go on while a fifth of their pairs
   is linked. A round costs at most one pair a node, so a family of any size costs a few. Links found
   join the classes of their ends, and buckets of one class are left out of later rounds.
4. Buckets that hold several classes even then are not paired out. Two texts whose similarity, weighted
   or plain, reaches the threshold share one of their rarest shingles (``rare_shingles``, an exact prefix
   filter). All nodes of open buckets are grouped by those. In a group of several classes
   the nodes outside its largest class meet one node in it, again while that links one in a hundred; those
   still in different classes then meet, a pair once, if this can be the first shingle they share.
   What only shares a frequent passage shares no rare shingle and is not compared.
   Pairs are verified on their shingles but for those that cannot be similar: how many
   shingles, and of which weight, fall into each of ``BINS`` bins bounds what two texts share. A
   pair is linked if its weighted similarity reaches the threshold, or the plain one does: rare
   edits of a text with very many copies weigh more than what they share.
5. Links become classes by passing on the smallest label and jumping to the label's label.

Words are runs of other characters than space and U+0009 to U+000D, with A-Z lower-cased;
a text of one to four words is one shingle. Cases: texts without words, null ones included, are copies of one
another. Null ids count as the smallest, and then the class has the id null. Rows equal
in id and text are both in the result. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, keyed, partitions, worker_cache
from .common import save as _save
from .records import slices_of
from .wordhash import Words, mix, shingles

KEY = ["_id", "_tie"]
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 13, 5
HASHES = BANDS * ROWS
#: counters of the sketch, and how many are sent together
COUNTERS, BLOCK = 1 << 20, 1 << 12
#: rows of the table of random draws; a shingle's hash picks its row
DRAWS, SEED = 1 << 14, 99
#: bins of a text's shingles, for the bound of a pair's similarity
BINS = 64
#: pairs whose bounds are computed at a time
BOUNDS_AT_ONCE = 4_096
#: power of the inverse document frequency in a weight
DAMPING = 0.5
#: star rounds in buckets go on while such a share of their pairs is linked; what is left is for the rare shingles
WORTH = 0.2
#: the same for rounds among nodes that share a rare shingle, after which every pair left is formed
WORTH_RARE = 0.01
#: rare shingles sent on together
FLAT = 200_000
#: shingles sampled at a time
AT_ONCE = 8_192
#: bytes of rows that go to a Python worker at a time; a row with the shingles of two texts may have hundreds of kilobytes
BATCH_BYTES = 8 << 20
#: the shingles of all nodes are sent to where pairs lie up to so many bytes, every round anew; beyond it pairs are shuffled to them
SENT_BYTES = 24 << 20


def save(df: DataFrame, name: str) -> DataFrame:
    """``common.save``, with rows going to Python in batches of ``BATCH_BYTES``."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH_BYTES))
    try:
        return _save(df, name)
    finally:
        conf.set(key, before)


def weighted_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Different shingles of each text, how often each occurs, and the bounds of the texts."""
    words = Words(texts)
    values, bounds = shingles(words, SHINGLE)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(values)))
    return values[at], counts, np.searchsorted(owner[at], np.arange(len(texts) + 1)), words


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(44)).astype(np.int64) & (COUNTERS - 1)


def document_counts(documents: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch of all documents' shingles (``COUNTERS`` numbers), and how many documents there are."""

    def count(batches):
        import pyarrow as pa

        sketch, n = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for start, stop in slices_of(batch.column(0)):
                values, *_ = weighted_shingles(batch.column(0).slice(start, stop - start).to_pylist())
                sketch += np.bincount(_counter(values), minlength=COUNTERS)
                n += stop - start
        if n:
            blocks = sketch.reshape(-1, BLOCK)
            used = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(used, -1), pa.int32()), pa.array([*(blocks[k].astype("<i4").tobytes() for k in used), np.int64(n).tobytes()])],
                names=["block", "counts"],
            )

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}  # at most one for each block
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.frombuffer(counts, "<i8" if block < 0 else "<i4").astype(np.int64)
                sums[block] = sums[block] + found if block in sums else found
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
            names=["block", "counts"],
        )

    schema = "block int, counts binary"
    parts = documents.select("_text").mapInArrow(count, schema)
    merged = save(parts.repartition(partitions(documents.sparkSession), "block").mapInArrow(add, schema), "sketch")
    sketch, n = np.zeros((COUNTERS // BLOCK, BLOCK), np.int64), 0
    for r in merged.collect():  # of fixed size, whatever the corpus
        found = np.frombuffer(r["counts"], "<i8")
        if r["block"] < 0:
            n += int(found[0])
        else:
            sketch[r["block"]] = found
    return sketch.ravel(), n


def log_frequencies(sketch: np.ndarray, n: int) -> np.ndarray:
    """The logarithm of each counter's inverse document frequency, damped."""
    return (DAMPING * np.log(np.log1p(max(n, 1) / np.maximum(sketch, 1)))).astype(np.float32)


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: the widths (gamma), the offsets (uniform) and the logs of the heights (gamma)."""
    cache = worker_cache("words")
    if "draws" not in cache:
        rng = np.random.default_rng(SEED)
        shape = (DRAWS, HASHES)
        cache["draws"] = (
            rng.standard_gamma(2, shape, np.float32), rng.random(shape, np.float32),
            np.log(rng.standard_gamma(2, shape, np.float32)),
        )
    return cache["draws"]


def samples(values: np.ndarray, log_weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``HASHES`` samples of each text: the hash of the shingle drawn and of its level."""
    width, offset, height = _draws()
    n = len(bounds) - 1
    best = np.full((n, HASHES), np.inf, np.float32)
    drawn = np.zeros((n, HASHES), np.uint64)
    columns = np.arange(HASHES)
    for at in range(0, len(values), AT_ONCE):
        some = values[at : at + AT_ONCE]
        rows = (some & np.uint64(DRAWS - 1)).astype(np.int64)
        r, b = width[rows], offset[rows]
        level = np.floor(log_weights[at : at + AT_ONCE, None] / r + b)
        cost = height[rows] - r * (level + 1 - b)
        first = int(np.searchsorted(bounds, at, side="right")) - 1
        last = int(np.searchsorted(bounds, at + len(some), side="left"))
        for text in range(first, last):
            start, stop = max(bounds[text] - at, 0), min(bounds[text + 1] - at, len(some))
            if start >= stop:
                continue
            pick = cost[start:stop].argmin(axis=0) + start
            low = cost[pick, columns]
            better = low < best[text]
            best[text] = np.where(better, low, best[text])
            token = some[pick] + level[pick, columns].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            drawn[text] = np.where(better, token, drawn[text])
    return mix(drawn)


def smallest(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``HASHES`` unweighted samples of each text: the smallest of its shingles' hashes."""
    seeds = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    best = np.full((len(bounds) - 1, HASHES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), AT_ONCE):
        stop = min(at + AT_ONCE, len(values))
        hashed = mix(values[at:stop, None] ^ seeds)
        first = int(np.searchsorted(bounds, at, side="right")) - 1
        last = int(np.searchsorted(bounds, stop, side="left"))
        texts = np.arange(first, last)
        texts = texts[bounds[texts + 1] > np.maximum(bounds[texts], at)]
        low = np.minimum.reduceat(hashed, np.maximum(bounds[texts] - at, 0), axis=0)
        best[texts] = np.minimum(best[texts], low)
    return best


def binned(values: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many shingles of each text fall into each bin, and after these their weights."""
    n = len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(bounds)) * BINS + (values >> np.uint64(58)).astype(np.int64)
    parts = [np.bincount(at, w, n * BINS).reshape(n, BINS) for w in (None, weights)]
    return np.concatenate(parts, axis=1).astype("<f4")


def may_link(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of ``binned`` rows can reach the threshold: two texts share no more of a
    bin than the one that has less of it."""
    found = np.zeros(len(a), bool)
    for at in range(0, len(a), BOUNDS_AT_ONCE):
        x, y = (part[at : at + BOUNDS_AT_ONCE].reshape(-1, 2, BINS) for part in (a, b))
        low = np.minimum(x, y).sum(axis=2)
        total = x.sum(axis=2) + y.sum(axis=2)
        # a little less is asked for than the threshold, as sums are rounded
        found[at : at + BOUNDS_AT_ONCE] = ((1 + threshold) * low >= (1 - 1e-4) * threshold * total).any(axis=1)
    return found


def similarities(a: tuple, b: tuple) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two texts' ``(shingles, weights)``."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    union = len(a[0]) + len(b[0]) - len(common)
    return (float(low / total) if total else 1.0), (len(common) / union if union else 1.0)


def signatures(documents: DataFrame, log_idf) -> DataFrame:
    """A written table: ``_id, _tie, node, bands`` of every row.

    ``node`` is a digest of the words, ``bands`` the bucket of each band (weighted ones first).
    """
    id_type = documents.schema["_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        names = np.arange(2 * BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for batch in batches:
            texts = batch.column(2)
            for start, stop in slices_of(texts):
                values, counts, bounds, words = weighted_shingles(texts.slice(start, stop - start).to_pylist())
                logs = np.log(counts).astype(np.float32) + log_idf.value[_counter(values)]
                drawn = np.concatenate((samples(values, logs, bounds), smallest(values, bounds)), axis=1)
                bands = names[None, :] * np.ones((len(drawn), 1), np.uint64)
                for k in range(ROWS):
                    bands = mix(bands + drawn[:, k::ROWS])
                some = np.diff(bounds) > 0
                nodes = []
                for k in range(stop - start):
                    own = words.hashes[words.bounds[k] : words.bounds[k + 1]]
                    nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                head = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        head.column(0), head.column(1), pa.array(nodes, pa.binary()),
                        pa.array([bands[k].astype(np.int64) if s else [] for k, s in enumerate(some)], pa.list_(pa.int64())),
                    ],
                    names=["_id", "_tie", "node", "bands"],
                )

    return save(
        documents.select(*KEY, "_text").mapInArrow(run, f"_id {id_type}, _tie long, node binary, bands array<long>"),
        "signatures",
    )


def rare_shingles(values: np.ndarray, weights: np.ndarray, log_idf: np.ndarray, threshold: float) -> tuple:
    """The shingles of a text of which every similar text has one among its own: ``(places, rest, behind)``.

    Shingles stand in one order for all texts, rarest first. What is left behind those returned is less than the threshold's
    share of the text, by number and by weight, so a text that has none of them in front shares too little.
    ``rest`` and ``behind`` are the number and the weight of the shingles from each one on.
    """
    order = np.lexsort((values, -log_idf))
    behind = np.cumsum(weights[order][::-1])[::-1]
    # a little more is taken than needed, as sums are rounded
    heavy = int((behind >= (1 - 1e-4) * threshold * behind[0]).sum()) if len(values) else 0
    many = len(values) - int(np.ceil((1 - 1e-9) * threshold * len(values))) + 1
    n = min(max(heavy, many), len(values))
    return order[:n], len(values) - np.arange(n), behind[:n]


def _named(pairs: DataFrame) -> DataFrame:
    """``x, y, cx, cy``: pairs of different numbers, each once, and the two classes they would join; the smaller first."""
    return pairs.where("x != y").select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"),
        F.least("cx", "cy").alias("cx"), F.greatest("cx", "cy").alias("cy"),
    ).distinct()


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """A written table: ``key, num, first``, each node in each of its buckets that hold others too."""
    rows = nodes.select("num", F.explode("bands").alias("key"))
    heads = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("num").alias("first")).where("n > 1")
    return save(rows.join(heads.drop("n"), "key").select("key", "num", "first"), "buckets")


def _rows_of(bins: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bins), "<f4").reshape(-1, 2 * BINS)


def bounded(pairs: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """A written table of those ``_named`` pairs that can be similar enough."""
    names = ["x", "y", "cx", "cy"]

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            close = may_link(*(_rows_of(batch.column(i).to_pylist()) for i in (4, 5)), threshold)
            yield batch.filter(pa.array(close)).select(names)

    def side(number):
        return parts.select(F.col("num").alias(number), F.col("bins").alias(f"b{number}"))

    both = pairs.join(side("x"), "x").join(side("y"), "y").select(*names, "bx", "by")
    return save(both.mapInArrow(keep, "x long, y long, cx long, cy long"), "pairs")


def node_shingles(shared: DataFrame, nodes: DataFrame, members: DataFrame, documents: DataFrame, log_idf) -> DataFrame:
    """A written table: ``node, num, values, counts, bins``, the shingles of every node that shares a bucket and what ``may_link`` needs."""
    wanted = save(
        nodes.join(shared.select("num").distinct(), "num").select("node", "num", "rep._id", "rep._tie"), "wanted"
    )
    texts = attach(documents.select(*KEY, "_text"), wanted, KEY, "inner", F.lit(80)).select("node", "num", "_text")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in slices_of(batch.column(2)):
                values, counts, bounds, _ = weighted_shingles(batch.column(2).slice(start, stop - start).to_pylist())
                logs = np.log(counts).astype(np.float32) + log_idf.value[_counter(values)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(start, stop - start) for k in (0, 1)]
                    + [pa.array([x[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()) for x in (values, counts.astype("<i4"))]
                    + [pa.array([row.tobytes() for row in binned(values, np.exp(logs), bounds)], pa.binary())],
                    names=["node", "num", "values", "counts", "bins"],
                )

    found = texts.mapInArrow(cut, "node binary, num long, values binary, counts binary, bins binary")
    # rows equal in id and text come more than once; without such there is nothing to shuffle
    if not members.groupBy(*KEY).count().where("count > 1").isEmpty():
        found = found.dropDuplicates(["node"])
    return save(found, "shingles")


def sent_if_small(parts: DataFrame) -> DataFrame:
    """Written ``node_shingles`` as the side of a join, broadcast if they were counted and are within the limits."""
    width = F.lit(64) + F.octet_length("values") + F.octet_length("counts") + F.octet_length("bins")
    size = parts.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return F.broadcast(parts) if size["n"] <= BROADCAST_ROWS and size["b"] <= SENT_BYTES else parts


def relabelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the class of each node, ``cls``, after the links ``found``, which name the classes they join.

    Only those classes are gone through, not every link so far.
    """
    new = components(found.select(F.col("cx").alias("a"), F.col("cy").alias("b"))).withColumnRenamed("node", "cls")
    return rows.join(new, "cls", "left").withColumn("cls", F.coalesce("class", "cls")).select(*rows.columns)


def open_buckets(rows: DataFrame) -> DataFrame:
    """A written table: those ``key, num, first, cls`` whose bucket holds several classes, with ``first_cls``, that of its first node."""
    classes = rows.groupBy("key").agg(
        F.min("cls").alias("low"), F.max("cls").alias("high"), F.max(F.when(F.col("num") == F.col("first"), F.col("cls"))).alias("first_cls")
    ).where("low != high")
    return save(rows.join(classes.select("key", "first_cls"), "key"), "classed")


def rare_rows(open_nodes: DataFrame, parts: DataFrame, log_idf, threshold: float) -> DataFrame:
    """A written table: ``num, size, total, token, log_idf, rest, behind``, the rare shingles of some nodes."""

    def cut(batches):
        import pyarrow as pa

        names = ["num", "size", "total", "token", "log_idf", "rest", "behind"]

        def flat(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=names)

        for batch in batches:
            found, held = [], 0
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                values = np.frombuffer(batch.column(1)[i].as_py(), np.uint64)
                logs = log_idf.value[_counter(values)]
                weights = np.frombuffer(batch.column(2)[i].as_py(), "<i4") * np.exp(logs).astype(np.float64)
                at, rest, behind = rare_shingles(values, weights, logs, threshold)
                own = (numbers[i], np.int32(len(values)), weights.sum())
                found.append((
                    *(np.repeat(x, len(at)) for x in own), values[at].astype(np.int64),
                    logs[at].astype(np.float64), rest.astype(np.int32), behind,
                ))
                held += len(at)
                if held > FLAT:
                    yield flat(found)
                    found, held = [], 0
            if found:
                yield flat(found)

    return save(
        parts.join(open_nodes.select("num"), "num", "left_semi").select("num", "values", "counts").mapInArrow(
            cut, "num long, size int, total double, token long, log_idf double, rest int, behind double"
        ),
        "rare-shingles",
    )


def open_groups(rare: DataFrame, found: DataFrame) -> DataFrame:
    """A written table: the rows of shingles that several classes have (``num, cls``), with ``main``, the largest of them."""
    rows = rare.join(found, "num")
    one, two = F.xxhash64("num"), F.xxhash64("num", F.lit(1))
    sizes = rows.groupBy("token", "cls").agg(
        F.count("*").alias("n"), F.bit_xor(one).alias("one"), F.bit_xor(two).alias("two"), F.max("log_idf").alias("log_idf")
    )
    groups = sizes.groupBy("token").agg(
        F.count("*").alias("classes"), F.sum("n").alias("n"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"),
        F.max("log_idf").alias("log_idf"), F.max(F.struct("n", "cls")).alias("main"),
    ).where("classes > 1")
    # of shingles that the same nodes have, the first in order stands for all
    groups = groups.groupBy("one", "two", "n").agg(
        F.min(F.struct(-F.col("log_idf"), F.col("token").alias("token"))).alias("least"), F.first("main.cls").alias("main")
    ).select("least.token", "main")
    return save(rows.join(groups, "token"), "open-shingles")


def to_largest(rows: DataFrame, turn: int) -> DataFrame:
    """``_named`` pairs: each node outside the largest class of a shingle with one node in it, for one of its shingles."""
    hubs = rows.where("cls = main").groupBy("token").agg(F.min(F.struct(F.xxhash64("num", F.lit(turn)), "num")).alias("hub"))
    return _named(rows.where("cls != main").join(hubs, "token").groupBy("num", "cls").agg(
        F.min(F.struct(F.xxhash64("token", F.lit(turn)), "hub.num", "main")).alias("of")
    ).select(F.col("num").alias("x"), F.col("of.num").alias("y"), F.col("cls").alias("cx"), F.col("of.main").alias("cy")))


def across(rows: DataFrame, threshold: float) -> DataFrame:
    """``_named`` pairs of nodes in different classes that have a rare shingle in common."""
    values = ("num", "cls", "size", "total", "rest", "behind")
    left = rows.where("cls != main").select("token", *(F.col(c).alias(f"l_{c}") for c in values))
    share = F.lit((1 - 1e-4) * threshold / (1 + threshold))

    def enough(rest, whole):
        """Whether two texts can be similar of which this is the first shingle in common."""
        return F.least(rest, f"l_{rest}") >= share * (F.col(whole) + F.col(f"l_{whole}"))

    # a pair within the largest class is never formed; outside of it the smaller number comes first
    met = left.join(rows, "token").where(
        (F.col("cls") != F.col("l_cls")) & ((F.col("cls") == F.col("main")) | (F.col("l_num") < F.col("num")))
        & (enough("rest", "size") | enough("behind", "total"))
    )
    return _named(met.select(F.col("l_num").alias("x"), F.col("num").alias("y"), F.col("l_cls").alias("cx"), F.col("cls").alias("cy")))


def verified(pairs: DataFrame, parts: DataFrame, log_idf, threshold: float) -> DataFrame:
    """A written table of the written pairs whose texts are similar enough: ``a, b``, their nodes, and ``cx, cy``."""

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                sides = []
                for at in (4, 5):
                    values = np.frombuffer(batch.column(at)[i].as_py(), np.uint64)
                    counts = np.frombuffer(batch.column(at + 2)[i].as_py(), "<i4")
                    sides.append((values, counts * np.exp(log_idf.value[_counter(values)])))
                linked.append(max(similarities(*sides)) >= threshold)
            yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b", "cx", "cy"])

    def side(number, name):
        return parts.select(
            F.col("num").alias(number), F.col("node").alias(name), F.col("values").alias(f"v{name}"), F.col("counts").alias(f"c{name}")
        )

    both = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y").select("a", "b", "cx", "cy", "va", "vb", "ca", "cb")
    return save(both.mapInArrow(keep, "a binary, b binary, cx long, cy long"), "links")


def components(links: DataFrame) -> DataFrame:
    """``node, class`` of every node in a link; a class is named by its smallest node."""
    both = save(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("class")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("a"), "class"), "a").groupBy(F.col("b").alias("node")).agg(
            F.min("class").alias("heard")
        )
        lower = labels.join(heard, "node").select("node", F.col("class").alias("was"), F.least("class", "heard").alias("class"))
        jumps = labels.select(F.col("node").alias("class"), F.col("class").alias("next"))
        new = save(
            lower.join(jumps, "class").select("node", "was", F.least("class", "next").alias("class")), "labels"
        )
        labels = new.select("node", "class")
        if new.where("was != class").isEmpty():
            return labels


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``_id, _tie, first, first_tie``: every row with the smallest row of its class."""
    documents = keyed(docs, id_col, text_col)
    sketch, n = document_counts(documents)
    log_idf = docs.sparkSession.sparkContext.broadcast(log_frequencies(sketch, n))  # of fixed size
    members = signatures(documents, log_idf)
    nodes = save(
        members.groupBy("node").agg(
            F.min(F.struct(*KEY)).alias("rep"), F.first("bands").alias("bands")
        ).withColumn("num", F.xxhash64("node")),
        "nodes",
    )
    shared = shared_buckets(nodes)
    parts = node_shingles(shared, nodes, members, documents, log_idf)
    sides = sent_if_small(parts)

    # each node meets the first node of one of its buckets, then of one of those in another class
    rows = shared.withColumn("cls", F.col("num"))
    stars = shared.groupBy("num").agg(F.min("first").alias("y")).select(
        F.col("num").alias("x"), "y", F.col("num").alias("cx"), F.col("y").alias("cy")
    )
    links, turn = [], 0
    while True:
        pairs = bounded(_named(stars), sides, threshold)
        found = verified(pairs, sides, log_idf, threshold)
        links.append(found)
        rows = open_buckets(relabelled(rows, found))
        met = pairs.count()
        if found.count() < WORTH * met or not met:
            break
        turn += 1
        stars = rows.where("cls != first_cls").groupBy("num", "cls").agg(
            F.min(F.struct(F.xxhash64("first", F.lit(turn)), "first", "first_cls")).alias("of")
        ).select(F.col("num").alias("x"), F.col("of.first").alias("y"), F.col("cls").alias("cx"), F.col("of.first_cls").alias("cy"))
        rows = rows.drop("first_cls")

    # then, of the buckets that hold several classes even now, whoever has a rare shingle in common
    open_nodes = save(rows.select("num", "cls").distinct(), "open-nodes")
    groups = open_groups(rare_rows(open_nodes, parts, log_idf, threshold), open_nodes)
    while True:  # first one node of a shingle's largest class, as long as that links
        turn += 1
        pairs = bounded(to_largest(groups, turn), sides, threshold)
        found = verified(pairs, sides, log_idf, threshold)
        linked = found.count()
        if not linked:
            break
        links.append(found)
        open_nodes = save(relabelled(open_nodes, found), "open-nodes")
        groups = open_groups(groups.drop("cls", "main"), open_nodes)
        if linked < WORTH_RARE * pairs.count():
            break
    links.append(verified(bounded(across(groups, threshold), sides, threshold), sides, log_idf, threshold))

    grouped = components(reduce(DataFrame.union, links))
    firsts = nodes.select("node", "rep").join(grouped, "node", "left").withColumn("class", F.coalesce("class", "node"))
    best = firsts.groupBy("class").agg(F.min("rep").alias("best"))
    named = save(firsts.join(best, "class").select("node", F.col("best._id").alias("first"), F.col("best._tie").alias("first_tie")), "classes")
    return attach(members.select(*KEY, "node"), named, ["node"], "left", F.lit(80)).select(*KEY, "first", "first_tie")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, class_id``: every row's id and the smallest id of its class."""
    found = classes(docs, threshold, id_col, text_col)
    kind = docs.schema[id_col].dataType
    if dict(found.dtypes)["_id"] == "bigint":
        def back(c):
            return F.when(F.col(c) != F.lit(-(2**63)), F.col(c)).cast(kind)
    else:
        def back(c):
            return F.when(F.col(c) != "", F.col(c)).cast(kind)
    return found.select(back("_id").alias("id"), back("first").alias("class_id"))


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their class, one a class; columns stay as they are."""
    found = save(classes(docs, threshold, id_col, text_col), "near-classes")
    dropped = found.where((F.col("_id") != F.col("first")) | (F.col("_tie") != F.col("first_tie"))).select(*KEY).distinct()
    left = attach(keyed(docs, id_col, text_col), save(dropped, "dropped"), KEY, "left_anti")
    # rows that repeat one another in id and text are each first: one of them stays
    repeated = save(
        found.where((F.col("_id") == F.col("first")) & (F.col("_tie") == F.col("first_tie")))
        .groupBy(*KEY).count().where("count > 1").select(*KEY),
        "repeated",
    )
    if repeated.isEmpty():
        return left.select("_row.*")
    twice = attach(left, repeated, KEY, "left_semi").dropDuplicates(KEY)
    return attach(left, repeated, KEY, "left_anti").select("_row.*").unionByName(twice.select("_row.*"))
