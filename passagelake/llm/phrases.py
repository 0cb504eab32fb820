"""Collocations: phrases whose words stand together more often than they would by chance.

*Prefix-free parsing.* A text becomes one line of words, with a line break in place of every mark that
ends a phrase. It is cut where a window of ``max_words - 1`` words has a hash that the modulus
divides, and a chunk runs up to the end of the next such window, so neighbours overlap by one
window and equal passages are cut alike wherever they stand. The dictionary holds each different chunk
once with its frequency in the parse; everything after reads the dictionary. A phrase of up to ``max_words`` words lies whole in
the chunk in which it begins, and belongs to it alone: what begins in the closing window
is counted in the next chunk.

*Counting, level by level.* A phrase can be frequent only if the phrases of one word less in
it are. For each length the hashes of phrases that may still be frequent are added up: a task
sorts its own and packs them, 40 bits of hash and a small count in 6 bytes, by range of hash; one task a range adds
them up. The frequent ones become a bitmap, which only ever lets too much through. In the end the
phrases that passed are counted as text, exactly.

*Scores.* Each cut of a candidate in two gives a score from whole numbers in decimals; counts
of both parts are found among the frequent phrases, as a part is at least as frequent as the whole.

Cases: a null or empty text has no words; a null language is ``und``. Every row is a document, also if
its id is null or repeated; other columns than text and language are not read. Runs of text without a window that cuts are cut
after ``LONGEST`` words all the same, so texts of any length are parsed whole. Words of any length are words. An empty
table has no phrases.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, partitions, save, text_of
from .flat import flat, strings
from .records import slices_of
from .wordhash import FOLD, hashed_words, mix

#: one window in so many ends a chunk, and no chunk owns more words than this
MODULUS, LONGEST = 32, 256
#: bytes of text that are looked at together, and packed counts that a task holds
AT_ONCE, HELD = 2 << 20, 2_000_000
#: bits of a bitmap for each frequent phrase, and the most bits it has
BITS_EACH, MOST_BITS = 32, 1 << 28
_FACTOR = np.uint64(0x9DDFEA08EB382D69)
#: what bytes mean: 1 between words, 2 between phrases
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 9]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOW = np.uint64(255)


def lined(data: np.ndarray) -> np.ndarray:
    """Folded bytes with one space between words, or one line break where a phrase ends."""
    data = FOLD[data]
    kind = _KIND[data]
    gap = kind > 0
    first = gap.copy()
    first[1:] &= ~gap[:-1]
    where = np.flatnonzero(first)
    out = data.copy()
    if len(where):
        ends = np.maximum.reduceat(kind, where)  # words in between count as 0
        out[where] = np.where(ends == 2, 0x0A, 0x20)
    return out[~gap | first]


class Line:
    """Words of lined bytes: ``starts``, ``ends``, ``hashes``, and whether a phrase ends behind each."""

    def __init__(self, data: np.ndarray):
        gap = (data == 0x20) | (data == 0x0A)
        before = np.concatenate(([True], gap[:-1]))
        self.data = data
        self.starts = np.flatnonzero(~gap & before)
        self.ends = np.flatnonzero(gap & ~before)
        self.hashes = hashed_words(data, gap, self.starts)
        self.breaks = data[self.ends] == 0x0A

    def __len__(self) -> int:
        return len(self.starts)


def windows(line: Line, size: int) -> np.ndarray:
    """A hash of every window of words, the separators between them included."""
    n = max(len(line) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mix(h * _FACTOR + line.hashes[k : k + n] + line.breaks[k : k + n].astype(np.uint64) * np.uint64(k + 1 < size))
    return h


def chunk_starts(line: Line, row_of: np.ndarray, overlap: int) -> np.ndarray:
    """Words at which a chunk begins. ``row_of`` names the row of each word."""
    n = len(line)
    begins = np.zeros(n, bool)
    h = windows(line, overlap)
    whole = row_of[: len(h)] == row_of[overlap - 1 : overlap - 1 + len(h)]
    begins[: len(h)] = whole & ((h >> np.uint64(20)) % np.uint64(MODULUS) == 0)
    begins[np.flatnonzero(np.diff(row_of, prepend=-1))] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, n))
    extra = (sizes - 1) // LONGEST
    if not extra.any():
        return starts
    inner = np.repeat(starts, extra) + LONGEST * (
        np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    )
    # only where a whole window follows in the same row
    inner = inner[inner + overlap <= n]
    inner = inner[row_of[inner + overlap - 1] == row_of[inner]]
    return np.sort(np.concatenate((starts, inner)))


def parse(docs: DataFrame, max_words: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The dictionary, as a table: ``lang, chunk, tail, f``.

    ``tail`` says that the chunk closes its text and so owns all its words. Words are
    separated by one space or line break, and one line break ends the chunk.
    """
    overlap = max(max_words - 1, 1)
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.concat(text_of(text_col), F.lit("\n")).alias("text"),
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1)
            for start, stop in slices_of(texts, AT_ONCE):
                data, bounds = flat(texts.slice(start, stop - start))
                line, rows_at = _lined_rows(data, bounds)
                if not len(line):
                    continue
                row_of = np.searchsorted(rows_at, line.starts, side="right") - 1
                begins = chunk_starts(line, row_of, overlap)
                ends = np.append(begins[1:], len(line))
                tail = np.append(row_of[begins[1:]] != row_of[begins[:-1]], True)
                last = np.where(tail, ends, ends + overlap) - 1
                low, high = line.starts[begins], line.ends[last] + 1
                sizes = high - low
                stops = np.cumsum(sizes)
                where = np.repeat(low - (stops - sizes), sizes) + np.arange(int(stops[-1]))
                copied = line.data[where]
                copied[stops - 1] = 0x0A
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(start + row_of[begins])),
                        strings(copied, np.concatenate(([0], stops))).cast(pa.string()),
                        pa.array(tail),
                    ],
                    ["lang", "chunk", "tail"],
                )

    chunks = rows.mapInArrow(run, "lang string, chunk string, tail boolean")
    return save(chunks.groupBy("lang", "chunk", "tail").agg(F.count("*").alias("f")), "chunks")


def _lined_rows(data: np.ndarray, bounds: np.ndarray) -> tuple[Line, np.ndarray]:
    """The line of all rows (each ends with a line break), and where each row begins in it.

    A gap at the start of a row joins the one that ends the row before.
    """
    gap = _KIND[data] > 0
    kept = ~gap
    kept[:1] = True
    kept[1:] |= ~gap[:-1]
    return Line(lined(data)), np.concatenate(([0], np.cumsum(kept)))[bounds[:-1]]


class Counted:
    """The words of some dictionary rows, with what a phrase that begins at each counts for."""

    def __init__(self, langs, chunks, tails, weights, overlap: int):
        data, bounds = flat(chunks)
        self.line = Line(data)
        row_of = np.searchsorted(bounds, self.line.starts, side="right") - 1
        n = len(self.line)
        last = np.searchsorted(row_of, np.arange(len(bounds) - 1), side="right")
        owned = np.where(tails, last, last - overlap)
        self.owned = np.arange(n) < owned[row_of]
        self.passing: dict = {}
        self.weight = np.where(self.owned, weights[row_of], 0)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        names = [int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in self.langs.to_pylist()]
        self.lang = coded.indices.to_numpy()[row_of]
        self.salt = np.array(names, np.uint64)[self.lang] if n else np.empty(0, np.uint64)

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the phrases of so many words, and where there is one (at every word)."""
        n = len(self.line)
        h, there = self.salt.copy(), np.ones(n, bool)
        for k in range(size):
            h = mix(h * _FACTOR + np.concatenate((self.line.hashes[k:], np.zeros(min(k, n), np.uint64))))
            if k:
                there[max(n - k, 0) :] = False
                if n > k:
                    there[: n - k] &= ~self.line.breaks[k - 1 : n - 1]
        return h, there


def _counted(batch, overlap: int):
    for start, stop in slices_of(batch.column(1), AT_ONCE):
        some = batch.slice(start, stop - start)
        yield Counted(
            some.column(0), some.column(1), some.column(2).to_numpy(zero_copy_only=False),
            some.column(3).to_numpy(), overlap,
        )


class Bitmap:
    """The hashes that may be frequent."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (8 * len(bits)).bit_length() + 1)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _passing(counted: Counted, size: int, bitmaps: list[Bitmap]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of phrases, and where one begins whose shorter parts all may be frequent (all
    of its own length too, if there is a bitmap for it)."""
    key = size, min(len(bitmaps), size)
    if key in counted.passing:
        return counted.passing[key]
    h, there = counted.phrases(size)
    n = len(h)
    if size > 1:
        _, part = _passing(counted, size - 1, bitmaps[: size - 1])
        there &= part & np.concatenate((part[1:], np.zeros(min(1, n), bool)))
    if len(bitmaps) >= size:
        there &= bitmaps[size - 1].passes(h)
    counted.passing[key] = h, there
    return h, there


def _packed(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The upper 40 bits of hashes, and counts below 256, as one number of 48 bits each."""
    return (hashes >> np.uint64(24) << np.uint64(8)) | counts.astype(np.uint64)


def _six_bytes(entries: np.ndarray) -> bytes:
    return entries.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data) -> np.ndarray:
    """Numbers from 6 bytes each."""
    short = np.frombuffer(data, np.uint8).reshape(-1, 6)
    whole = np.zeros((len(short), 8), np.uint8)
    whole[:, :6] = short
    return whole.view("<u8").ravel().astype(np.uint64)


def _add_up(entries: np.ndarray, top: int) -> np.ndarray:
    """Packed counts with one entry a hash; counts go no higher than ``top``."""
    entries = np.sort(entries)
    hashes = entries >> np.uint64(8)
    first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)))
    if not len(first):
        return entries
    sums = np.add.reduceat((entries & _LOW).astype(np.int64), first)
    return (hashes[first] << np.uint64(8)) | np.minimum(sums, top).astype(np.uint64)


def frequent_hashes(chunks: DataFrame, size: int, min_count: int, bitmaps, overlap: int) -> DataFrame:
    """``hashes``: packed hashes of all phrases of ``size`` words that may have the count."""
    top, ranges = min(min_count, 255), partitions(chunks.sparkSession)

    def pack(batches):
        import pyarrow as pa

        maps = [Bitmap(b.value) for b in bitmaps]
        held, n = [], 0

        def out():
            entries = _add_up(np.concatenate(held), top)
            # ranges of the hash's upper 32 bits
            upper = (entries >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)
            cuts = np.searchsorted(upper, np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([_six_bytes(entries[cuts[k] : cuts[k + 1]]) for k in some], pa.binary())],
                ["range", "entries"],
            )

        for batch in batches:
            for counted in _counted(batch, overlap):
                h, there = _passing(counted, size, maps)
                there = there & counted.owned
                held.append(_add_up(_packed(h[there], np.minimum(counted.weight[there], top)), top))
                n += len(held[-1])
                if n > HELD:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def add(batches):
        import pyarrow as pa

        own, held = None, []

        def out():
            entries = _add_up(np.concatenate(held), top)
            frequent = entries[(entries & _LOW) >= top]
            return pa.RecordBatch.from_arrays(
                [pa.array([len(frequent)]), pa.array([_six_bytes(frequent)], pa.binary())], ["n", "hashes"]
            )

        for batch in batches:
            for k, entries in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != own and held:
                    yield out()
                    held = []
                own = k
                held.append(_unpacked(entries.as_buffer()))
                if len(held) >= 64:
                    held = [_add_up(np.concatenate(held), top)]
        if held:
            yield out()

    packed = chunks.select("lang", "chunk", "tail", "f").mapInArrow(pack, "range int, entries binary")
    sorted_ranges = packed.repartition(ranges, "range").sortWithinPartitions("range")
    return save(sorted_ranges.mapInArrow(add, "n long, hashes binary"), "frequent-hashes")


def bitmap_of(hashes: DataFrame):
    """A broadcast bitmap of packed hashes; its size is bounded by ``MOST_BITS``."""
    spark = hashes.sparkSession
    n = hashes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(max(1 << (BITS_EACH * n).bit_length(), 1 << 16), MOST_BITS)
    shift = np.uint64(48 - bits.bit_length() + 1)
    slices = 16

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            for value in batch.column(0):
                at = np.unique(_unpacked(value.as_buffer()) >> shift)
                own = at // np.uint64(bits // slices)
                for k in np.unique(own):
                    part = np.zeros(bits // slices, bool)
                    part[at[own == k] - k * np.uint64(bits // slices)] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(k)], pa.int32()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())],
                        ["slice", "bits"],
                    )

    def merge(batches):
        import pyarrow as pa

        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(value.as_buffer(), np.uint8)
                merged[k] = merged[k] | part if k in merged else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(merged), pa.int32()), pa.array([v.tobytes() for v in merged.values()], pa.binary())], ["slice", "bits"]
        )

    parts = hashes.where("n > 0").select("hashes").mapInArrow(mark, "slice int, bits binary")
    merged = parts.repartition(slices, "slice").mapInArrow(merge, "slice int, bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    size = bits // 8 // slices
    for row in merged.collect():  # the slices of one bitmap
        whole[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(whole)


def count_phrases(chunks: DataFrame, max_words: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``lang, phrase, words, f`` of all phrases of ``min_count`` or more, and
    ``lang, n``, all word occurrences."""
    overlap = max(max_words - 1, 1)
    bitmaps: list = []
    for size in range(1, max_words + 1):
        bitmaps.append(bitmap_of(frequent_hashes(chunks, size, min_count, list(bitmaps), overlap)))

    def count(batches):
        import pyarrow as pa

        maps = [Bitmap(b.value) for b in bitmaps]
        for batch in batches:
            for counted in _counted(batch, overlap):
                line = counted.line
                for size in range(max_words + 1):
                    if size:
                        _, there = _passing(counted, size, maps)
                        found = _texts(line, there & counted.owned, size)
                    else:
                        found = [(np.flatnonzero(counted.owned), np.zeros(int(counted.owned.sum()), np.int64), [""])]
                    for where, codes, texts in found:
                        both = counted.lang[where].astype(np.int64) * len(texts) + codes
                        kinds, place = np.unique(both, return_inverse=True)
                        sums = np.zeros(len(kinds), np.int64)
                        np.add.at(sums, place, counted.weight[where])
                        yield pa.RecordBatch.from_arrays(
                            [
                                counted.langs.take(pa.array(kinds // max(len(texts), 1))),
                                pa.array(texts, pa.string()).take(pa.array(kinds % max(len(texts), 1))),
                                pa.array(np.full(len(kinds), size, np.int32)),
                                pa.array(sums),
                            ],
                            ["lang", "phrase", "words", "f"],
                        )

    counts = (
        chunks.select("lang", "chunk", "tail", "f").mapInArrow(count, "lang string, phrase string, words int, f long")
        .groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
        .where((F.col("f") >= min_count) | (F.col("words") == 0))
    )
    counts = save(counts, "phrases")
    return counts.where("words > 0"), counts.where("words = 0").select("lang", F.col("f").alias("n"))


def _texts(line: Line, there: np.ndarray, size: int):
    """The phrases that begin at some words: where, the code of each, and what the codes mean.

    Every ``size``-th word bounds a run of phrases that lie side by side in the bytes, so each
    run is a column over the line itself.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for phase in range(size):
        bounds = np.append(line.starts, line.ends[-1] + 1 if len(line) else 0)[phase::size]
        wanted = there[phase::size][: max(len(bounds) - 1, 0)]
        if not wanted.any():
            continue
        base = bounds[0]
        column = strings(line.data[base : bounds[-1]], bounds - base, text=True)
        coded = column.filter(pa.array(wanted)).dictionary_encode()
        # what follows the last word is the separator behind the phrase
        yield phase + size * np.flatnonzero(wanted), coded.indices.to_numpy().astype(np.int64), pc.utf8_slice_codeunits(coded.dictionary, 0, -1)


def _cuts(candidates: DataFrame) -> DataFrame:
    """One row for each way to cut a phrase in two."""
    words = F.split("phrase", " ", -1)
    cut = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda k: F.struct(
            k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"),
            F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("rest"),
        ),
    )
    return candidates.select("lang", "phrase", F.col("f").alias("a"), F.inline(cut))


def _sub_phrases(candidates: DataFrame) -> DataFrame:
    """Each shorter run of two words or more inside each candidate, with the candidate's count."""
    words = F.split("phrase", " ", -1)
    n = F.size(words)
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), n - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), n - size + 1), lambda at: F.array_join(F.slice(words, at, size), " ")
            ),
        )
    )
    return candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("longer"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), in decimals: the products may pass 64 bits."""
    wide = "decimal(16,0)"
    top = (F.lit(1_000_000).cast("decimal(7,0)") * (a.cast(wide) * a.cast(wide))).cast("decimal(38,0)")
    bottom = (left.cast(wide) * right.cast(wide)).cast("decimal(38,0)")
    # the remainder is exact, so what is divided leaves none
    return ((top - top % bottom) / bottom).cast("decimal(38,0)").cast("long")


def collocations(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, covered: int = 50, top: int = 2000,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase inside a longer candidate that has ``covered`` percent of its count is left out.
    """
    chunks = parse(docs, max_words, lang_col, text_col)
    frequent, totals = count_phrases(chunks, max_words, min_count)
    candidates = frequent.where("words > 1")
    counts = frequent.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))

    def with_count(rows: DataFrame, part: str, name: str) -> DataFrame:
        side = counts.select("lang", F.col("part").alias(part), F.col("part_f").alias(name))
        return attach(rows, side, ["lang", part], "inner", F.octet_length(part) + 64)

    cuts = with_count(with_count(_cuts(candidates), "first", "l"), "rest", "r")
    scored = cuts.select("lang", "phrase", "a", "l", "r", "k", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = save(_sub_phrases(candidates).groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), "longer-phrases")
    kept = attach(lowest, inside, ["lang", "phrase"], "left", F.octet_length("phrase") + 64).where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return attach(ranked, totals, ["lang"], "inner").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"),
    )
