"""BM25 where the postings lie: whole document buckets, in blocks with their greatest worth.

The postings of a segment are split by bucket of document, and a bucket's chunks over ``WINDOWS``
windows. A *block* is a row: the entries of one term in one window, with the greatest term
frequency and the least length among them, which bound what any of them can add to a score
whatever the average length has become. Everything about a chunk lies in one piece of one bucket, in one
file that one task reads, so a task adds up its scores and takes the best of every question without
any exchange. A bucket of a larger segment has more pieces, so no task groups or reads more than
about ``PIECE_CHUNKS`` chunks at a time. A window is looked into only if its terms' bounds together reach the
``limit``-th best score found by then; ties are looked into, so nothing is lost.

Weights reach the tasks as arrays of checked size; beyond it the postings are joined and shuffled
(:func:`.lexical.bm25_scores`), with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx

#: the windows of a bucket
WINDOWS = 16
#: a bucket has one piece for about so many chunks; windows are dealt to that many pieces, beyond it they are split too
PIECE_CHUNKS, WINDOW_PIECES = 4_000, 4
#: blocks that a task hands on at a time
BATCH_BLOCKS = 10_000
#: files of postings are written as one row group each; one may be a little less than this size
ONE_GROUP = 1 << 30
ENTRY = "struct<doc_id:string,ordinal:int,number:long,tf:int,length:int>"
BLOCKS = f"term string, window int, n int, max_tf int, min_length int, entries array<{ENTRY}>"
HIT = "query_id string, doc_id string, ordinal int, score double"
WEIGHT = ("query_id", "pos", "term", "weight_idf", "n_groups")
LIMIT = ("query_id", "doc_id")
NAMED = ("query_id", "set")
PLACED = ("segment", "doc_bucket", "set", "number")


def window_of() -> Column:
    return F.pmod(F.xxhash64("doc_id", "ordinal"), F.lit(WINDOWS)).cast("int")


def pieces_for(chunks: int, buckets: int) -> int:
    """The pieces of each bucket of a segment: a power of two, by its size."""
    pieces = 1
    while pieces * buckets * PIECE_CHUNKS < chunks:
        pieces *= 2
    return pieces


def piece_of(pieces: int) -> Column:
    """The piece of a chunk; up to ``WINDOW_PIECES`` of them, a piece has whole windows."""
    few = min(pieces, WINDOW_PIECES)
    # what the window does not say about the chunk deals it further
    rest = F.pmod(F.shiftright(F.xxhash64("doc_id", "ordinal"), 8), F.lit(pieces // few))
    return (F.pmod(window_of(), F.lit(few)) * F.lit(pieces // few) + rest).cast("int")


def blocks(chunks: DataFrame, buckets: int, pieces: int = 1) -> DataFrame:
    """The blocks of written chunks (with ``doc_bucket``), each ``piece`` of a bucket in one partition.

    A piece is of bounded size, so a task holds it as columns and puts all of its entries in order at once.
    """
    dealt = chunks.where("length > 0").select(
        "doc_bucket", piece_of(pieces).alias("piece"), "doc_id", "ordinal", "number", "length",
        window_of().alias("window"), F.col("counts.term").alias("terms"), F.col("counts.tf").alias("tfs"),
    ).repartition(buckets * pieces, "doc_bucket", "piece").sortWithinPartitions("doc_bucket", "piece")
    return dealt.mapInArrow(_grouped, f"doc_bucket int, piece int, {BLOCKS}")


def _grouped(batches):
    """The blocks of one piece after the other; chunks come in the order of their pieces."""
    own, parts = None, []
    for batch in batches:
        buckets, pieces = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        changes = np.flatnonzero((np.diff(buckets) != 0) | (np.diff(pieces) != 0)) + 1
        for low, high in zip([0, *changes], [*changes, batch.num_rows]):
            if low == high:
                continue
            key = int(buckets[low]), int(pieces[low])
            if key != own and parts:
                yield from _blocks_of(own, parts)
                parts = []
            own = key
            parts.append(batch.slice(int(low), int(high - low)))
    if parts:
        yield from _blocks_of(own, parts)


def _blocks_of(key: tuple[int, int], parts: list):
    """Batches with the blocks of some chunks, by term and window, entries by document and ordinal."""
    import pyarrow as pa

    table = pa.Table.from_batches(parts)
    column = {name: table.column(name).combine_chunks() for name in table.column_names}
    rows = table.num_rows
    ordinal, number, length, window = (column[k].to_numpy() for k in ("ordinal", "number", "length", "window"))
    sizes = column["terms"].value_lengths().to_numpy()
    names, term = ranked(column["terms"].flatten())
    tf = column["tfs"].flatten().to_numpy()
    docs = column["doc_id"].cast(pa.string())
    place = np.empty(rows, np.int64)
    place[np.lexsort((number, ordinal, ranked(docs)[1]))] = np.arange(rows)
    row = np.repeat(np.arange(rows), sizes)
    group = term * WINDOWS + window[row]
    order = np.argsort(group * rows + place[row])
    group, row, tf = group[order], row[order], tf[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(starts[1:], len(group))
    n, first = len(starts), group[starts]
    greatest = np.maximum.reduceat(tf, starts) if n else tf
    least = np.minimum.reduceat(length[row], starts) if n else length[row]
    for low in range(0, n, BATCH_BLOCKS):
        high = min(n, low + BATCH_BLOCKS)
        own = slice(starts[low], ends[high - 1])
        at = row[own]
        entries = pa.StructArray.from_arrays(
            [docs.take(pa.array(at)), *map(pa.array, (ordinal[at], number[at], tf[own], length[at]))],
            ["doc_id", "ordinal", "number", "tf", "length"],
        )
        offsets = np.append(starts[low:high], ends[high - 1]) - starts[low]
        some = first[low:high]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(high - low, key[0], np.int32)), pa.array(np.full(high - low, key[1], np.int32)),
                names.take(pa.array(some // WINDOWS)), pa.array((some % WINDOWS).astype(np.int32)),
                pa.array((ends - starts)[low:high].astype(np.int32)), pa.array(greatest[low:high]), pa.array(least[low:high]),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entries),
            ],
            ["doc_bucket", "piece", "term", "window", "n", "max_tf", "min_length", "entries"],
        )


def entries(rows: DataFrame) -> DataFrame:
    """One row a posting: ``term, chunk_id, doc_id, ordinal, tf, length``."""
    flat = rows.select("term", "doc_bucket", F.inline("entries"))
    return flat.select(
        "term", F.concat_ws(":", "doc_id", F.col("ordinal").cast("string")).alias("chunk_id"),
        "doc_id", "ordinal", "tf", "length", "doc_bucket",
    )


@dataclass(frozen=True)
class Asked:
    """The weights of all questions as arrays, by term and then by question."""

    query_ids: list[str]
    short: np.ndarray
    first_of: dict[str, tuple[int, int]]
    query: np.ndarray
    pos: np.ndarray
    weight: np.ndarray
    #: the documents of all limited questions, and by question the places of those it may find
    scope_docs: list[str]
    allowed: dict[int, np.ndarray]
    #: the sets of documents that limited questions name, by question
    sets: dict[int, np.ndarray] = field(default_factory=dict)


def asked(weights, scope, sets=None) -> Asked:
    """From ``query_id, pos, term, weight_idf, n_groups`` and ``query_id, doc_id``, or the
    ``query_id, set`` of numbered sets of documents.

    All may be written tables, which reach the driver as columns, or lists of rows. A row
    takes a few numbers here: as objects, half a million of them would fill the driver.
    """
    rows = _columns(weights, WEIGHT).sort_by([(k, "ascending") for k in ("term", "query_id", "pos")])
    ids, query = _coded(rows["query_id"])
    names, term = _coded(rows["term"])
    short = np.zeros(len(ids), bool)
    short[query] = rows["n_groups"].to_numpy() <= lx.SHORT_QUESTION_TERMS
    cuts = np.flatnonzero(np.diff(term, prepend=-1)).tolist()
    ends = [*cuts[1:], len(term)]
    first_of = {names[term[low]]: (low, high) for low, high in zip(cuts, ends)}
    docs, allowed, named = [], {}, {}
    if scope is not None:
        limits = _columns(scope, LIMIT)
        docs, which = _coded(limits["doc_id"])
        allowed = _by_question(limits["query_id"], which, ids)
    if sets is not None:
        limits = _columns(sets, NAMED)
        named = _by_question(limits["query_id"], limits["set"].to_numpy(), ids)
    return Asked(
        ids, short, first_of, query, rows["pos"].to_numpy().astype(np.int64),
        rows["weight_idf"].to_numpy().astype(float), docs, allowed, named,
    )


def _by_question(query_id, what: np.ndarray, ids: list[str]) -> dict[int, np.ndarray]:
    place = {q: i for i, q in enumerate(ids)}
    limited, who = _coded(query_id)
    order = np.argsort(who, kind="stable")
    parts = np.split(what[order].astype(np.int32), np.flatnonzero(np.diff(who[order])) + 1)
    return {place[q]: part for q, part in zip(limited, parts) if q in place}


def numbers_by_set(rows, segments: list[str]) -> dict[tuple[str, int], dict[int, np.ndarray]]:
    """The numbers of the documents of every set by segment and bucket, in order.

    ``rows`` is a written table ``segment, doc_bucket, set, number`` (the segment by its place)
    of checked size, which reaches the driver as columns.
    """
    columns = {k: v.to_numpy() for k, v in zip(PLACED, _columns(rows, PLACED).columns)}
    order = np.lexsort([columns[k] for k in reversed(PLACED)])
    segment, bucket, which, number = (columns[k][order] for k in PLACED)
    cuts = np.flatnonzero(
        (np.diff(segment, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0) | (np.diff(which, prepend=-1) != 0)
    )
    found: dict[tuple[str, int], dict[int, np.ndarray]] = {}
    for low, part in zip(cuts, np.split(number, cuts[1:])):
        found.setdefault((segments[segment[low]], int(bucket[low])), {})[int(which[low])] = part
    return found


def _columns(rows, names: tuple[str, ...]):
    """Columns of a written table, or of rows in a list, as an Arrow table."""
    import pyarrow as pa

    if isinstance(rows, DataFrame):
        return rows.select(*names).toArrow()
    return pa.table({name: pa.array([r[name] for r in rows]) for name in names})


def ranked(column):
    """The distinct strings of a column in order, and the place of each row's string."""
    import pyarrow as pa
    import pyarrow.compute as pc

    coded = column.cast(pa.string()).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order, pa.int64())), rank[coded.indices.to_numpy()]


def _coded(column) -> tuple[list[str], np.ndarray]:
    names, places = ranked(column.combine_chunks())
    return names.to_pylist(), places


def _worth(tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    """Term frequency part of BM25."""
    tf = tf.astype(float)
    norm = lx.BM25_K1 * ((1.0 - lx.BM25_B) + lx.BM25_B * (length / average))
    return tf * (lx.BM25_K1 + 1.0) / (tf + norm)


def _steady(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e9 + 0.5) / 1e9


def ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Bucket:
    """The blocks of one bucket that hold terms of some question."""

    def __init__(
        self, parts: list, question: Asked, average: float, gone: list[tuple[int, int]],
        members: dict[int, np.ndarray] | None = None,
    ):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.Table.from_batches(parts).combine_chunks()
        column = {name: table.column(name).combine_chunks() for name in table.column_names}
        lists = column["entries"]
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        field = {k: flat.field(i) for i, k in enumerate(("doc_id", "ordinal", "number", "tf", "length"))}
        coded = field["doc_id"].dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.docs = coded.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.doc = rank[coded.indices.to_numpy()]
        # where the scopes have these documents
        known = pc.index_in(self.docs, value_set=pa.array(question.scope_docs, self.docs.type))
        self.scoped = known.fill_null(-1).to_numpy()
        self.ordinal = field["ordinal"].to_numpy(zero_copy_only=False)
        self.stride = int(self.ordinal.max(initial=0)) + 1
        #: chunks in the order of document and ordinal
        self.chunks, self.chunk = np.unique(self.doc * self.stride + self.ordinal, return_inverse=True)
        self.worth = _worth(field["tf"].to_numpy(zero_copy_only=False), field["length"].to_numpy(zero_copy_only=False), average)
        self.live = np.ones(len(self.doc), bool)
        number = field["number"].to_numpy(zero_copy_only=False)
        self.members, self._held = members or {}, {}
        if question.sets:
            self.numbers, self.numbered = np.unique(number, return_inverse=True)
        if gone:
            words = np.array(sorted(gone), np.int64).reshape(-1, 2)
            where = np.minimum(np.searchsorted(words[:, 0], number >> 6), len(words) - 1)
            bit = (words[where, 1] >> (number & 63)) & 1
            self.live = ~((words[where, 0] == number >> 6) & (bit == 1))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.window = column["window"].to_numpy(zero_copy_only=False)
        self.bound = _worth(
            column["max_tf"].to_numpy(zero_copy_only=False), column["min_length"].to_numpy(zero_copy_only=False), average
        )
        # every block meets the weights of its term
        spans = np.array([question.first_of.get(t, (0, 0)) for t in column["term"].to_pylist()], np.int64).reshape(-1, 2)
        self.block = np.repeat(np.arange(len(spans)), spans[:, 1] - spans[:, 0])
        self.entry = ranges(spans[:, 0], spans[:, 1])
        by_query = np.argsort(question.query[self.entry], kind="stable")
        self.block, self.entry = self.block[by_query], self.entry[by_query]
        self.question = question
        self.looked_at = self.passed_over = 0

    def _in_set(self, which: int) -> np.ndarray:
        """Which of the documents here belong to a set."""
        if which not in self._held:
            own = self.members.get(which, np.full(1, np.iinfo(np.int64).min))
            where = np.minimum(np.searchsorted(own, self.numbers), len(own) - 1)
            self._held[which] = own[where] == self.numbers
        return self._held[which]

    def _scores(self, which: np.ndarray, query: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks and scores from some pairs of block and weight."""
        block, entry = self.block[which], self.entry[which]
        at = ranges(self.starts[block], self.ends[block])
        size = self.ends[block] - self.starts[block]
        weight = np.repeat(self.question.weight[entry], size)
        pos = np.repeat(self.question.pos[entry], size)
        seen = self.live[at]
        allowed = self.question.allowed.get(query)
        if allowed is not None:
            seen = seen & np.isin(self.scoped, allowed)[self.doc[at]]
        sets = self.question.sets.get(query)
        if sets is not None:
            seen = seen & np.logical_or.reduce([self._in_set(s) for s in sets.tolist()])[self.numbered[at]]
        at, weight, pos = at[seen], weight[seen], pos[seen]
        place, size = self.chunk[at], len(self.chunks)
        total = np.bincount(place, weight * self.worth[at], size)
        if self.question.short[query]:
            found = np.flatnonzero(np.bincount(place, minlength=size))
        else:
            # two different words must match: some other than the one seen first
            first = np.zeros(size, np.int64)
            first[place[::-1]] = pos[::-1]
            found = np.flatnonzero(np.bincount(place, pos != first[place], size))
        return self.chunks[found], _steady(total[found])

    def best(self, query: int, low: int, high: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The best chunks of a question, whose pairs are those from ``low`` to ``high``."""
        pairs = np.arange(low, high)
        window = self.window[self.block[pairs]]
        bounds = np.bincount(window, self.bound[self.block[pairs]] * self.question.weight[self.entry[pairs]], WINDOWS)
        size = np.bincount(window, self.ends[self.block[pairs]] - self.starts[self.block[pairs]], WINDOWS)
        order = np.argsort(-bounds, kind="stable")
        # the most promising windows, until they could fill the limit
        first = order[: int(np.searchsorted(np.cumsum(size[order]), limit)) + 1]
        chosen = np.zeros(WINDOWS, bool)
        chosen[first] = True
        chunk, score = self._scores(pairs[chosen[window]], query)
        floor = np.partition(score, -limit)[-limit] if len(score) >= limit else -np.inf
        rest = np.flatnonzero((size > 0) & ~chosen)
        worth_it = rest[_steady(bounds[rest]) + 1e-6 >= floor]
        self.looked_at += len(first) + len(worth_it)
        self.passed_over += len(rest) - len(worth_it)
        if len(worth_it):
            chosen[:] = False
            chosen[worth_it] = True
            more = self._scores(pairs[chosen[window]], query)
            chunk, score = np.concatenate((chunk, more[0])), np.concatenate((score, more[1]))
        top = np.lexsort((chunk, -score))[:limit]
        return chunk[top], score[top]

    def hits(self, limit: int):
        """A batch with the best chunks of every question."""
        import pyarrow as pa

        query = self.question.query[self.entry]
        cuts = np.flatnonzero(np.diff(query, prepend=-1))
        queries, chunks, scores = [], [], []
        for low, high in zip(cuts, np.append(cuts[1:], len(query))):
            own = int(query[low])
            chunk, score = self.best(own, int(low), int(high), limit)
            queries += [self.question.query_ids[own]] * len(chunk)
            chunks.append(chunk)
            scores.append(score)
        chunk = np.concatenate([np.empty(0, np.int64), *chunks])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(queries, pa.string()), self.docs.take(pa.array(chunk // self.stride)).cast(pa.string()),
                pa.array((chunk % self.stride).astype(np.int32)), pa.array(np.concatenate([np.empty(0), *scores])),
            ],
            ["query_id", "doc_id", "ordinal", "score"],
        )


def best_in_buckets(
    rows: DataFrame, question: Asked, average: float, limit: int, gone: dict | None = None,
    members: dict | None = None,
) -> DataFrame:
    """``query_id, doc_id, ordinal, score``: the best ``limit`` of every question in every file.

    ``rows`` are blocks as read, with ``segment`` and ``doc_bucket``; ``gone`` maps these two
    to the bitmap of deleted documents, ``members`` to the numbers of documents of the sets.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((question, {k: list(v) for k, v in (gone or {}).items()}, members or {}))
    terms = sorted(question.first_of)
    if len(terms) <= 1000:
        rows = rows.where(F.col("term").isin(*terms) if terms else F.lit(False))
    else:
        wanted = spark.createDataFrame([(t,) for t in terms], "term string")
        rows = rows.join(F.broadcast(wanted), "term", "left_semi")
    whole = F.col("_size") < int(ONE_GROUP * 0.9)
    read = rows.select(
        "segment", "doc_bucket", "term", "window", "max_tf", "min_length", "entries", whole.alias("whole")
    )

    def run(batches):
        question, gone, members = sent.value
        own, parts = None, []

        def out():
            return Bucket(parts, question, average, gone.get(own, []), members.get(own)).hits(limit)

        for batch in batches:
            if not batch.num_rows:
                continue
            if not all(batch.column(7).to_pylist()):
                raise ValueError("A file of postings has several row groups: use more doc_buckets.")
            segments, buckets = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            codes = segments.indices.to_numpy()
            names = segments.dictionary.to_pylist()
            changes = np.flatnonzero((np.diff(codes) != 0) | (np.diff(buckets) != 0)) + 1
            for low, high in zip([0, *changes], [*changes, batch.num_rows]):
                key = names[codes[low]], int(buckets[low])
                if key != own and parts:
                    yield out()
                    parts = []
                own = key
                parts.append(batch.slice(int(low), int(high - low)))
        if parts:
            yield out()

    return read.mapInArrow(run, HIT)
