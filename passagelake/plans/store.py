"""Durable tables: append-only Parquet segments, made visible by a commit.

Every ingest writes one segment to each table and then an entry to the commit log
(:mod:`.log`). Readers look only at committed segments, so a job that dies half way leaves
nothing behind that counts, and running it again under the same segment name overwrites its files.

Documents are numbered within their segment. A deletion is a sparse bitmap of such numbers for each
segment and bucket (64 numbers a word), and term counts to subtract. It names rows of certain
segments, so what is added later under the same id, or committed meanwhile, is not touched.
Bitmaps up to ``INLINE_WORDS`` words lie in the log itself, larger ones in a table; either way they
meet the rows they are about by segment and bucket, and are never counted or joined by document.

An entry also has the rows of each table (counted as they were written) and the number of buckets they were
written in: readers choose joins and prune by that, and a new setting takes effect when compacting.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Settings
from ..operators.blockmax import BLOCKS, ONE_GROUP, blocks, pieces_for
from ..operators.postings import bucket
from .log import CommitLog, Conflict, State

SCHEMAS = {
    "documents": (
        "doc_id string, number long, filename string, extension string, size_bytes long, sha256 string, "
        "stored_path string, pages int, n_chunks int, n_words long, status string, "
        "error string, uploaded_at string"
    ),
    "chunks": (
        "chunk_id string, doc_id string, number long, ordinal int, page int, text string, n_words int, "
        "length int, counts array<struct<term:string,tf:int>>"
    ),
    "postings": BLOCKS,
    "vocabulary": "term string, df long",
    "grams": "gram string, term string, n_grams int, grams array<string>, signature long",
    # the order of grams, held by the segment that fixed it: any order gives right results
    # as long as all live segments and every question use the same one
    "gram_order": "gram string, holders long",
    "vectors": "chunk_id string, doc_id string, number long, vector array<double>",
    "files": "doc_id string, number long, content binary",
    # bitmaps too large for the log: numbers of documents of the segment ``target``
    "deletions": "target string, doc_bucket int, word long, bits long",
    "outcomes": (
        "filename string, doc_id string, status string, duplicate boolean, error string"
    ),
}
BUCKET = {
    "chunks": "doc_bucket",
    "postings": "doc_bucket",
    "vocabulary": "term_bucket",
    "grams": "gram_bucket",
}
SORTED_BY = {
    "chunks": ["doc_id", "ordinal"], "postings": ["term", "window"], "vocabulary": ["term"], "grams": ["gram"]
}
#: tables whose rows go when their document is deleted
BY_DOCUMENT = ("documents", "chunks", "postings", "vectors", "files")
#: totals that entries carry
TOTALS = ("documents", "words", "chunks", "n_chunks", "total_len", "vectors")
#: the largest bitmap of one deletion, in words, that lies in the log
INLINE_WORDS = 20_000


@dataclass(frozen=True)
class Snapshot:
    """What one reader sees: the live entries of the log and their summed totals."""

    state: State
    documents: int
    words: int
    chunks: int
    n_chunks: int
    total_len: int
    vectors: int
    #: (segment, bucket) -> [(word, bits)] of deletions in the log; others lie in ``gone_in``
    gone: dict = field(default_factory=dict, compare=False)
    gone_in: tuple[str, ...] = ()
    gone_words: int = 0

    @property
    def segments(self) -> tuple[str, ...]:
        """Segments with rows, deletions among them (they have term counts)."""
        return tuple(sorted(self.state.entries))

    @property
    def deletes(self) -> bool:
        return bool(self.gone or self.gone_in)

    def rows(self, table: str) -> int:
        """Rows of a table as written, deleted ones included."""
        return sum(e["rows"].get(table, 0) for e in self.state.entries.values())

    @property
    def average_length(self) -> float:
        return self.total_len / self.n_chunks if self.n_chunks and self.total_len else 1.0


class Store:
    def __init__(self, spark: SparkSession, root: str, settings: Settings) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        # what was asked for, and what the tables at hand were written with
        self.configured = self.settings = settings
        self.log = CommitLog(spark, f"{self.root}/log")
        self._written: dict[tuple[str, str], Observation] = {}

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _schema(self, table: str) -> StructType:
        extra = f", {BUCKET[table]} int" if table in BUCKET else ""
        return StructType.fromDDL(f"{SCHEMAS[table]}, segment string{extra}")

    def _load(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(self._schema(table)).parquet(self.path(table))
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing.getCondition()):
                raise
            return self.spark.createDataFrame([], self._schema(table))

    # -- commits ------------------------------------------------------------------

    def commits(self) -> list[dict]:
        """The live entries: one for each ingest or compaction, and one for each segment
        that a deletion took documents from."""
        return list(self.log.state().entries.values())

    def committed(self, segment: str) -> bool:
        state = self.log.state()
        return segment in state.entries or segment in state.replaced

    def snapshot(self) -> Snapshot:
        state = self.log.state()
        entries = state.entries.values()
        layouts = {(e["term_buckets"], e["doc_buckets"]) for e in entries}
        if len(layouts) > 1:
            raise ValueError(f"Segments are laid out in different numbers of buckets: {sorted(layouts)}.")
        self.settings = self.configured
        for terms, docs in layouts:
            self.settings = replace(self.configured, term_buckets=terms, doc_buckets=docs)
        gone: dict[tuple[str, int], list] = {}
        for e in entries:
            for k, words in e.get("gone", {}).items():
                gone.setdefault((e["target"], int(k)), []).extend(map(tuple, words))
        return Snapshot(
            state=state,
            **{t: sum(e[t] for e in entries) for t in TOTALS},
            gone=gone,
            gone_in=tuple(e["segment"] for e in entries if e["kind"] == "delete" and "gone" not in e),
            gone_words=sum(e.get("gone_words", 0) for e in entries),
        )

    def entry(self, segment: str, kind: str, created_at: str, **totals) -> dict:
        seen = {t: o.get for (t, s), o in self._written.items() if s == segment}
        return {
            "segment": segment, "kind": kind, "created_at": created_at,
            "rows": {t: int(o["rows"]) for t, o in seen.items()},
            # numbers of documents lie between -span and span
            "span": 2 + max([int(o["last"]) for o in seen.values() if "last" in o], default=-1),
            **{t: int(totals.get(t) or 0) for t in TOTALS},
            "term_buckets": self.settings.term_buckets, "doc_buckets": self.settings.doc_buckets,
        }

    def commit(self, segment: str, kind: str, created_at: str, supersedes=(), base: State | None = None, **totals) -> None:
        """Make a segment count. Segments in ``supersedes`` stop to, which fails if they have changed
        since ``base``; so does fixing an order of grams where one has been fixed meanwhile."""
        entry = self.entry(segment, kind, created_at, **totals)
        base = base or self.log.state()
        orders = entry["rows"].get("gram_order", 0) and not supersedes

        def check(now: State) -> None:
            for s in supersedes:
                if s not in now.entries:
                    raise Conflict(f"Segment {s} was replaced meanwhile.")
            late = [s for s in now.entries if s not in base.entries and now.entries[s].get("target") in supersedes]
            if late:
                raise Conflict(f"Documents of segments to be replaced were deleted meanwhile: {late}.")
            layouts = {(e["term_buckets"], e["doc_buckets"]) for s, e in now.entries.items() if s not in supersedes}
            if layouts - {(entry["term_buckets"], entry["doc_buckets"])}:
                raise Conflict("The tables were laid out anew meanwhile.")
            if orders and any(e["rows"].get("gram_order") for e in now.entries.values()):
                raise Conflict("An order of grams was fixed meanwhile.")

        self.log.append({"entries": [entry], "supersedes": list(supersedes)}, base, check)

    def commit_deletion(self, entries: list[dict], base: State) -> None:
        def check(now: State) -> None:
            lost = sorted({e["target"] for e in entries} - now.entries.keys())
            if lost:
                raise Conflict(f"Segments were replaced while documents of theirs were deleted: {lost}.")
            for e in entries:
                late = [s for s, x in now.entries.items() if x.get("target") == e["target"] and s not in base.entries]
                if late:
                    raise Conflict(f"Documents of segment {e['target']} were deleted meanwhile.")

        self.log.append({"entries": entries, "supersedes": []}, base, check)

    def vacuum(self) -> list[str]:
        """Delete the files of segments that a compaction replaced; returns their names.

        The log forgets them last, so a vacuum that was cut short can be run again. Readers
        that still hold a snapshot from before the compaction lose their files.
        """
        state = self.log.state()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in SCHEMAS:
            for segment in state.replaced:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/segment={segment}")
                path.getFileSystem(conf).delete(path, True)
        if state.replaced:
            self.log.append({"entries": [], "supersedes": [], "vacuumed": state.replaced}, state)
        return state.replaced

    def merge_candidates(self, fanout: int) -> list[list[str]]:
        """Groups of ``fanout`` or more segments of about one size (a power of ``fanout``)."""
        tiers: dict[int, list[str]] = {}
        for s, e in self.log.state().entries.items():
            if e["kind"] != "delete":
                tiers.setdefault(int(math.log(max(e["rows"].get("chunks", 0), 1), fanout)), []).append(s)
        return [sorted(group) for _, group in sorted(tiers.items()) if len(group) >= fanout]

    # -- tables -------------------------------------------------------------------

    def write(self, table: str, df: DataFrame, segment: str, lying: bool = False) -> DataFrame:
        """Write one segment of a table and return it as read back.

        Bucketed tables are rebalanced first: Spark sizes the files at run time and
        splits a bucket that one hot term or document makes too big. Postings are not: all
        of a piece of a bucket lies in one file of one row group, which a single task reads. Nor are
        rows ``lying`` in files of the same buckets, which are read and written bucket by bucket anyway.
        """
        columns = [f.name for f in StructType.fromDDL(SCHEMAS[table])]
        df = self.bucketed(table, df)
        target = f"{self.path(table)}/segment={segment}"
        column = BUCKET.get(table)
        whole = table == "postings"  # they lie as they were dealt for grouping
        out = df.select(*columns, *([column] if column else []))
        if column and not whole and not lying:
            out = out.hint("rebalance", column)
        if table in SORTED_BY:
            out = out.sortWithinPartitions(*([column] if column else []), *SORTED_BY[table])
        # rows are counted on the way
        seen = self._written[table, segment] = Observation()
        counted = [F.count(F.lit(1)).alias("rows")]
        if "number" in columns:
            counted.append(F.coalesce(F.max(F.abs("number")), F.lit(-1).cast("long")).alias("last"))
        writer = out.observe(seen, *counted).write.mode("overwrite")
        if whole:
            writer = writer.option("parquet.block.size", str(ONE_GROUP))
        (writer.partitionBy(column) if column else writer).parquet(target)
        return self.segment(table, segment)

    def write_postings(self, segment: str) -> DataFrame:
        """Write the postings of a segment whose chunks this store has just written."""
        rows = blocks(self.segment("chunks", segment), self.settings.doc_buckets, self._pieces(segment))
        return self.write("postings", rows, segment)

    def _pieces(self, segment: str) -> int:
        return pieces_for(self.written("chunks", segment), self.settings.doc_buckets)

    def bucketed(self, table: str, df: DataFrame) -> DataFrame:
        column = BUCKET.get(table)
        key = {"doc_bucket": "doc_id", "term_bucket": "term", "gram_bucket": "gram", None: None}[column]
        if key not in df.columns:  # blocks of postings know their bucket
            return df
        count = self.settings.doc_buckets if key == "doc_id" else self.settings.term_buckets
        return df.withColumn(column, bucket(key, count))

    def segment(self, table: str, segment: str) -> DataFrame:
        return self._load(table).where(F.col("segment") == segment)

    def written(self, table: str, segment: str) -> int:
        """Rows of a table that this store has just written."""
        return int(self._written[table, segment].get["rows"])

    def blocks(self, snapshot: Snapshot) -> DataFrame:
        """All blocks of postings as they lie, deleted documents among them, with the size of their file."""
        rows = self._rows("postings", snapshot, snapshot.segments)
        return rows.withColumn("_size", F.col("_metadata.file_size") if snapshot.rows("postings") else F.lit(0).cast("long"))

    def places(self, snapshot: Snapshot) -> DataFrame:
        """``segment, doc_bucket, doc_id, number`` of all chunks, deleted ones among them."""
        return self._rows("chunks", snapshot, snapshot.segments).select("segment", "doc_bucket", "doc_id", "number")

    def _rows(self, table: str, snapshot: Snapshot, segments) -> DataFrame:
        """All rows of some segments. Segments without any are known from the log."""
        entries = snapshot.state.entries
        holding = [s for s in segments if s in entries and entries[s]["rows"].get(table)]
        if not holding:
            return self.spark.createDataFrame([], self._schema(table))
        return self._load(table).where(F.col("segment").isin(*holding))

    def gone_in_memory(self, snapshot: Snapshot) -> dict | None:
        """The bitmaps of deletions by segment and bucket; None if they are too large to hold."""
        if snapshot.gone_words * 16 > self.settings.broadcast_mb << 20:
            return None
        found = {k: list(v) for k, v in snapshot.gone.items()}
        if snapshot.gone_in:
            for r in self._load("deletions").where(F.col("segment").isin(*snapshot.gone_in)).collect():
                found.setdefault((r["target"], r["doc_bucket"]), []).append((r["word"], r["bits"]))
        merged = {}
        for k, words in found.items():
            bits: dict[int, int] = {}
            for word, b in words:
                bits[word] = bits.get(word, 0) | b
            merged[k] = sorted(bits.items())
        return merged

    def gone(self, snapshot: Snapshot) -> DataFrame:
        """``segment, doc_bucket, words``: the numbers of deleted documents, as sparse bitmaps."""
        rows = [(s, k, word, bits) for (s, k), words in snapshot.gone.items() for word, bits in words]
        schema = "segment string, doc_bucket int, word long, bits long"
        found = self.spark.createDataFrame(rows, schema)
        if snapshot.gone_in:
            lying = self._load("deletions").where(F.col("segment").isin(*snapshot.gone_in))
            found = found.unionByName(lying.select(F.col("target").alias("segment"), "doc_bucket", "word", "bits"))
        pairs = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
        merged = found.groupBy("segment", "doc_bucket", "word").agg(F.bit_or("bits").alias("bits"))
        return merged.groupBy("segment", "doc_bucket").agg(pairs.alias("words"))

    def read(self, table: str, snapshot: Snapshot, segments=None, keep: bool = False) -> DataFrame:
        """The live rows of a table (of some ``segments``), with their segment if told to ``keep`` it."""
        wanted = snapshot.segments if segments is None else tuple(segments)
        rows = self._rows(table, snapshot, wanted)
        if snapshot.deletes and table in BY_DOCUMENT:
            rows = self._without(rows, self.gone(snapshot), snapshot)
        return rows if keep else rows.drop("segment")

    def _without(self, rows: DataFrame, gone: DataFrame, snapshot: Snapshot) -> DataFrame:
        columns = rows.columns
        if "doc_bucket" not in columns:
            rows = rows.withColumn("doc_bucket", bucket("doc_id", self.settings.doc_buckets))
        if snapshot.gone_words * 16 <= self.settings.broadcast_mb << 20:
            gone = F.broadcast(gone)
        met = rows.join(gone, ["segment", "doc_bucket"], "left")

        def live(number):
            bits = F.try_element_at("words", F.shiftright(number, 6))
            return F.coalesce(F.getbit(bits, F.pmod(number, F.lit(64)).cast("int")), F.lit(0)) == 0

        if "entries" not in columns:
            return met.where(live(F.col("number"))).select(*columns)
        left = F.when(F.col("words").isNull(), F.col("entries")).otherwise(
            F.filter("entries", lambda e: live(e["number"]))
        )
        return met.withColumn("entries", left).where(F.size("entries") > 0).withColumn("n", F.size("entries")).select(*columns)

    def vocabulary(self, snapshot: Snapshot, segments=None) -> DataFrame:
        """``term, df`` over the live corpus; terms nobody holds any more are gone."""
        rows = self.read("vocabulary", snapshot, segments)
        if len(snapshot.segments) <= 1:
            return rows
        summed = rows.groupBy("term_bucket", "term").agg(F.sum("df").alias("df"))
        return summed.where("df > 0")
