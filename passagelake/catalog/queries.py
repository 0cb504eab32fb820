"""The registered queries: each operator run over the whole of its tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import lexicon as lx
from ..functions import text as T
from ..operators import answer as A
from ..operators import postings as P
from ..operators.chunk import chunk_rows, sentence_units, text_blocks, with_chunks
from ..operators.context import merged_ranges, range_pieces
from ..operators.dense import dense_topk
from ..operators.fusion import fuse
from ..operators.intake import (
    checked_uploads,
    first_of_each,
    question_problem,
    turn_problem,
)
from ..operators.lexical import question_terms
from ..operators.ranks import nearest_ranks
from ..operators.scope import Scope
from ..plans.engine import Engine
from ..workspace import save, shared_folder

UPLOADED_AT = "2024-01-01T00:00:00+00:00"
SETTINGS = Settings()

_engines: dict[tuple[str, str, str], Engine] = {}


# -- inputs -----------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text"
    )


def uploads(spark, sf_dir) -> DataFrame:
    """Every document as the upload of a text file."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("doc_id").alias("position"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("text").cast("binary").alias("content"),
        "lang",
    )


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question")
    )


def document_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("doc_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def source_scope(spark, sf_dir) -> Scope:
    """Each question is limited to the source of the document with its number."""
    docs = table(spark, sf_dir, "documents").where(F.col("source").isNotNull())
    own = table(spark, sf_dir, "benchmark").select("item_id").join(
        docs.select(F.col("doc_id").alias("item_id"), F.col("source").alias("scope")), "item_id"
    )
    return Scope(
        own.select(F.col("item_id").cast("string").alias("query_id"), "scope"),
        docs.select(F.col("source").alias("scope"), F.col("doc_id").cast("string").alias("doc_id")),
    )


def _engine(spark, sf_dir, kind: str, build: Callable[[Engine], None]) -> Engine:
    """One index per session and input folder; later queries read its tables."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _engines:
        name = hashlib.sha256("|".join(key).encode()).hexdigest()[:16]
        engine = Engine(spark, f"{shared_folder(spark)}/index-{kind}-{name}", SETTINGS)
        build(engine)
        _engines[key] = engine
    return _engines[key]


def corpus(spark, sf_dir) -> Engine:
    def build(engine):
        engine.ingest(
            uploads(spark, sf_dir).drop("lang"),
            segment="documents",
            uploaded_at=UPLOADED_AT,
            vectors=document_vectors(spark, sf_dir),
        )

    return _engine(spark, sf_dir, "corpus", build)


def changed_corpus(spark, sf_dir) -> Engine:
    """English first, then everything again (so English is known), then the documents
    labelled toxic deleted."""
    def build(engine):
        everything = uploads(spark, sf_dir)
        english = everything.where("lang = 'en'").drop("lang")
        engine.ingest(english, segment="english", uploaded_at=UPLOADED_AT)
        engine.ingest(everything.drop("lang"), segment="everything", uploaded_at=UPLOADED_AT)
        toxic = table(spark, sf_dir, "labels").where("toxic = 1")
        engine.delete_documents(toxic.select(F.col("doc_id").cast("string").alias("doc_id")))

    return _engine(spark, sf_dir, "changed", build)


def readded_corpus(spark, sf_dir) -> Engine:
    """Everything, then the documents labelled toxic deleted and added again under their ids."""
    def build(engine):
        everything = uploads(spark, sf_dir).drop("lang")
        engine.ingest(everything, segment="first", uploaded_at=UPLOADED_AT)
        toxic = table(spark, sf_dir, "labels").where("toxic = 1")
        ids = toxic.select(F.col("doc_id").cast("string").alias("doc_id"))
        engine.delete_documents(ids)
        engine.ingest(everything.join(ids, "doc_id", "left_semi"), segment="again", uploaded_at=UPLOADED_AT)

    return _engine(spark, sf_dir, "readded", build)


def compacted_corpus(spark, sf_dir) -> Engine:
    """Like the changed corpus, but English in four parts, which are merged before the rest comes;
    last, everything is compacted."""
    def build(engine):
        everything = uploads(spark, sf_dir)
        for k in range(4):
            part = everything.where((F.col("lang") == "en") & (F.col("position") % 4 == k)).drop("lang")
            engine.ingest(part, segment=f"english-{k}", uploaded_at=UPLOADED_AT)
        engine.merge(fanout=4)
        engine.ingest(everything.drop("lang"), segment="everything", uploaded_at=UPLOADED_AT)
        toxic = table(spark, sf_dir, "labels").where("toxic = 1")
        engine.delete_documents(toxic.select(F.col("doc_id").cast("string").alias("doc_id")))
        engine.compact()

    return _engine(spark, sf_dir, "compacted", build)


def _page():
    """Page numbers with 0 for none, as an integer column without nulls compares best."""
    return F.coalesce("page", F.lit(0)).alias("page")


# -- text functions -----------------------------------------------------------------------


def _token_summary(spark, sf_dir, keep_stopwords):
    tokens = documents(spark, sf_dir).select(
        "doc_id", T.tokens(F.col("text"), keep_stopwords).alias("tokens")
    )
    return tokens.select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).alias("n_terms"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


def tokenize_documents(spark, sf_dir):
    return _token_summary(spark, sf_dir, False)


def tokenize_keep_stopwords(spark, sf_dir):
    return _token_summary(spark, sf_dir, True)


def fold_accents(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.md5(T.fold(F.col("text"))).alias("folded_md5")
    )


def stem_words(spark, sf_dir):
    words = documents(spark, sf_dir).select(
        F.explode_outer(F.array_distinct(T.raw_tokens(F.col("text")))).alias("word")
    )
    return words.where(F.col("word").isNotNull()).distinct().select(
        "word", T.stem(F.col("word")).alias("stem"), T.is_stopword(F.col("word")).alias("stopword")
    )


def char_trigrams(spark, sf_dir):
    vocabulary = corpus(spark, sf_dir).index().vocabulary
    grams = T.char_ngrams(F.col("term"))
    return vocabulary.select(
        "term",
        F.size(grams).alias("n_grams"),
        F.array_join(F.array_sort(grams), "|").alias("grams"),
    )


def jaccard_of_neighbours(spark, sf_dir):
    """Term overlap of each chunk with the next one of its document."""
    chunks = corpus(spark, sf_dir).index().chunks.select(
        "doc_id", "ordinal", F.col("counts.term").alias("terms")
    )
    following = chunks.select(
        "doc_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("terms").alias("next_terms")
    )
    return chunks.join(following, ["doc_id", "ordinal"]).select(
        "doc_id",
        "ordinal",
        F.round(T.jaccard(F.col("terms"), F.col("next_terms")), 6).alias("similarity"),
    )


def _positions(df, key, pieces, name):
    rows = df.select(key, F.posexplode_outer(pieces).alias("position", name))
    return rows.where(F.col(name).isNotNull())


def sentence_split(spark, sf_dir):
    return _positions(
        documents(spark, sf_dir), "doc_id", T.sentences(F.col("text")), "sentence"
    )


def quote_sentence_split(spark, sf_dir):
    return _positions(
        documents(spark, sf_dir), "doc_id", T.quote_sentences(F.col("text")), "sentence"
    )


def clean_text(spark, sf_dir):
    cleaned = documents(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("cleaned"))
    return cleaned.select(
        "doc_id", F.length("cleaned").alias("n_chars"), F.md5("cleaned").alias("cleaned_md5")
    )


def document_paragraphs(spark, sf_dir):
    blocks = documents(spark, sf_dir).select(
        "doc_id", text_blocks(F.col("text")).alias("blocks")
    )
    return _positions(blocks, "doc_id", F.col("blocks.text"), "paragraph").select(
        "doc_id", "position", F.md5("paragraph").alias("paragraph_md5")
    )


def page_paragraphs(spark, sf_dir):
    """The raw page source read as a text file."""
    pages = table(spark, sf_dir, "pages")
    return _positions(pages, "page_id", T.paragraphs(F.col("html")), "paragraph").select(
        "page_id", "position", F.md5("paragraph").alias("paragraph_md5")
    )


def word_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


def safe_filenames(spark, sf_dir):
    named = table(spark, sf_dir, "pages").select(
        "page_id", T.safe_filename(F.col("url")).alias("filename")
    )
    return named.select("*", T.extension(F.col("filename")).alias("extension"))


def snippets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def content_hashes(spark, sf_dir):
    return uploads(spark, sf_dir).select(
        "doc_id",
        F.sha2("content", 256).alias("sha256"),
        F.octet_length("content").alias("size_bytes"),
    )


def citations_in_text(spark, sf_dir):
    """Bracketed numbers in conversation turns with a citation appended to each."""
    turns = table(spark, sf_dir, "conversations")
    text = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit(", 3] [x] [3,1]"))
    return turns.select(
        "conv_id",
        "turn",
        F.array_join(T.citations(text, F.lit(5)).cast("array<string>"), ",").alias("cited"),
    )


# -- intake ---------------------------------------------------------------------------


def upload_checks(spark, sf_dir):
    """Web pages offered as uploads under their address."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.col("url").alias("filename"), F.col("html").cast("binary").alias("content")
    )
    return checked_uploads(pages, SETTINGS).select(
        "page_id", "filename", "extension", "size_bytes", "sha256", "rejected"
    )


def question_checks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id",
        "turn",
        question_problem(F.col("text"), F.col("turn")).alias("question_problem"),
        turn_problem(F.col("role"), F.col("text")).alias("turn_problem"),
    )


def dedup_documents(spark, sf_dir):
    hashed = uploads(spark, sf_dir).select(
        "doc_id", "position", F.sha2("content", 256).alias("sha256")
    )
    return first_of_each(hashed, ["sha256"], "position", "doc_id").select("sha256", "doc_id")


def ingest_outcomes(spark, sf_dir):
    engine = corpus(spark, sf_dir)
    return engine.store.segment("outcomes", "documents").select(
        "filename", "doc_id", "status", "duplicate", "error"
    )


def known_on_second_ingest(spark, sf_dir):
    engine = changed_corpus(spark, sf_dir)
    return engine.store.segment("outcomes", "everything").select(
        "filename", "doc_id", "status", "duplicate"
    )


# -- chunking -------------------------------------------------------------------------


def split_units(spark, sf_dir):
    units = documents(spark, sf_dir).select(
        "doc_id", sentence_units(text_blocks(F.col("text")), 30).alias("units")
    )
    rows = units.select("doc_id", F.posexplode_outer("units").alias("position", "u"))
    return rows.where(F.col("u").isNotNull()).select(
        "doc_id", "position", F.col("u.n").alias("n_words"), F.md5("u.text").alias("text_md5")
    )


def _chunks(spark, sf_dir, target, overlap):
    blocks = documents(spark, sf_dir).select(
        "doc_id", text_blocks(F.col("text")).alias("blocks")
    )
    return chunk_rows(with_chunks(blocks, target, overlap)).select(
        "chunk_id", "doc_id", "ordinal", _page(), "n_words", F.md5("text").alias("text_md5")
    )


def chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir, 180, 45)


def chunk_documents_small(spark, sf_dir):
    return _chunks(spark, sf_dir, 100, 25)


# -- index ------------------------------------------------------------------------------


def term_frequency(spark, sf_dir):
    return corpus(spark, sf_dir).index().postings.select("chunk_id", "term", "tf", "length")


def document_frequency(spark, sf_dir):
    return corpus(spark, sf_dir).index().vocabulary.select("term", "df")


def corpus_totals(spark, sf_dir):
    return P.corpus_totals(corpus(spark, sf_dir).index().chunks).select(
        "n_chunks",
        "total_len",
        F.round(F.col("total_len") / F.col("n_chunks"), 6).alias("average_length"),
    )


def index_stats(spark, sf_dir):
    postings = corpus(spark, sf_dir).index().postings
    return postings.agg(
        F.count_distinct("chunk_id").alias("chunks"),
        F.count_distinct("doc_id").alias("documents"),
        F.count_distinct("term").alias("vocabulary"),
    )


def store_stats(spark, sf_dir):
    engine = corpus(spark, sf_dir)
    docs = engine.documents().where("status = 'indexed'").agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"),
    )
    chunks = engine.chunks().agg(F.count("*").alias("chunks"))
    return docs.select("*", chunks.scalar().alias("chunks"))


def changed_vocabulary(spark, sf_dir):
    return changed_corpus(spark, sf_dir).index().vocabulary.select("term", "df")


def changed_stats(spark, sf_dir):
    engine = changed_corpus(spark, sf_dir)
    totals = P.corpus_totals(engine.index().chunks)
    live = engine.documents().where("status = 'indexed'")
    docs = live.agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    return totals.select(
        "n_chunks",
        "total_len",
        docs.select("n").scalar().alias("documents"),
        docs.select("words").scalar().alias("words"),
    )


# -- documents ------------------------------------------------------------------------


def list_documents(spark, sf_dir):
    return corpus(spark, sf_dir).list_documents().na.fill(0, ["pages"])


def document_previews(spark, sf_dir):
    return corpus(spark, sf_dir).previews().select(
        "doc_id", "ordinal", _page(), F.md5("text").alias("text_md5")
    )


def labelled_documents(spark, sf_dir):
    """Which labelled documents the index holds."""
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    held = corpus(spark, sf_dir).documents().select("doc_id", "filename", "n_chunks", "n_words")
    found = wanted.join(held, "doc_id", "left")
    return found.na.fill(0, ["n_chunks", "n_words"]).withColumn(
        "held", F.col("filename").isNotNull()
    )


def find_by_hash(spark, sf_dir):
    """The stored document that has the bytes of each upload."""
    stored = corpus(spark, sf_dir).documents().where("status = 'indexed'")
    return content_hashes(spark, sf_dir).join(
        stored.select("sha256", F.col("doc_id").alias("stored_id")), "sha256"
    ).select("doc_id", "stored_id")


def indexed_chunks(spark, sf_dir):
    return corpus(spark, sf_dir).indexed_chunks().select(
        "chunk_id", "doc_id", "ordinal", _page(), "n_words", F.md5("text").alias("text_md5")
    )


# -- ranking ----------------------------------------------------------------------------


def question_term_list(spark, sf_dir):
    return question_terms(questions(spark, sf_dir))


def fuzzy_expand(spark, sf_dir):
    index = corpus(spark, sf_dir).index()
    terms = question_terms(questions(spark, sf_dir)).select("term").distinct()
    return index.expansions(save(terms, "terms")).select(
        "q_term", "term", F.round("weight", 6).alias("weight"), "df"
    )


def _ranked(df):
    return df.select("query_id", "rank", "chunk_id", "doc_id", F.round("score", 6).alias("score"))


def bm25_topk(spark, sf_dir):
    index = corpus(spark, sf_dir).index()
    return _ranked(index.lexical(questions(spark, sf_dir), SETTINGS.candidate_k))


def bm25_scoped(spark, sf_dir):
    index = corpus(spark, sf_dir).index()
    return _ranked(
        index.lexical(
            questions(spark, sf_dir), SETTINGS.candidate_k, source_scope(spark, sf_dir)
        )
    )


def bm25_after_changes(spark, sf_dir):
    index = changed_corpus(spark, sf_dir).index()
    return _ranked(index.lexical(questions(spark, sf_dir), SETTINGS.candidate_k))


def bm25_after_compaction(spark, sf_dir):
    index = compacted_corpus(spark, sf_dir).index()
    return _ranked(index.lexical(questions(spark, sf_dir), SETTINGS.candidate_k))


def readded_documents(spark, sf_dir):
    """Documents deleted and added again are found once, by their new rows."""
    engine = readded_corpus(spark, sf_dir)
    chunks = engine.chunks().groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    return engine.documents().where("status = 'indexed'").join(chunks, "doc_id").select("doc_id", "n_chunks", "n_rows")


def event_value_ranks(spark, sf_dir):
    """Nearest ranks of the values of every type of event, as latencies are reported."""
    events = table(spark, sf_dir, "events")
    return nearest_ranks(events, "event_type", "value", [0.0, 0.5, 0.95, 0.99, 1.0])


def label_queries(spark, sf_dir):
    """One query vector per label: the unit vector along the mean of its members."""
    cells = table(spark, sf_dir, "embeddings").select(
        "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")
    )
    means = cells.groupBy("label", "i").agg(F.avg("x").alias("x"))
    vectors = means.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("i", "x"))).alias("cells")
    ).select("label", F.col("cells.x").alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select(
        F.col("label").cast("string").alias("query_id"),
        F.transform("mean", lambda x: x / norm).alias("vector"),
    )


def dense_ranking(spark, sf_dir):
    vectors = document_vectors(spark, sf_dir).withColumn("chunk_id", F.col("doc_id"))
    return _ranked(
        dense_topk(vectors, label_queries(spark, sf_dir), SETTINGS.candidate_k, SETTINGS)
    )


def question_vectors(spark, sf_dir):
    """The vector with a question's number stands for the question."""
    asked = questions(spark, sf_dir).select("query_id")
    vectors = document_vectors(spark, sf_dir).withColumnRenamed("doc_id", "query_id")
    return vectors.join(asked, "query_id", "left_semi")


def dense_chunks(spark, sf_dir):
    index = corpus(spark, sf_dir).index()
    return _ranked(
        dense_topk(
            index.vectors, question_vectors(spark, sf_dir), SETTINGS.candidate_k, SETTINGS
        )
    )


def dense_scoped(spark, sf_dir):
    index = corpus(spark, sf_dir).index()
    return _ranked(
        dense_topk(
            index.vectors,
            question_vectors(spark, sf_dir),
            SETTINGS.candidate_k,
            SETTINGS,
            source_scope(spark, sf_dir).pairs(),
        )
    )


def hybrid_search(spark, sf_dir):
    index = corpus(spark, sf_dir).index()
    return _ranked(
        index.search(
            questions(spark, sf_dir), query_vectors=question_vectors(spark, sf_dir)
        )
    )


def rank_fusion(spark, sf_dir):
    """Scoped lexical and unscoped dense rankings fused."""
    index = corpus(spark, sf_dir).index()
    limit = SETTINGS.candidate_k
    lexical = index.lexical(questions(spark, sf_dir), limit, source_scope(spark, sf_dir))
    dense = dense_topk(index.vectors, question_vectors(spark, sf_dir), limit, SETTINGS)
    return _ranked(fuse(lexical, dense, limit))


def _picks(spark, sf_dir, lambda_=None):
    index = corpus(spark, sf_dir).index()
    candidates = save(index.search(questions(spark, sf_dir)), "candidates")
    return index, index.select(candidates, SETTINGS.top_k, lambda_)


def mmr_select(spark, sf_dir):
    _, picks = _picks(spark, sf_dir)
    return picks.select("query_id", "pick", "chunk_id", F.round("score", 6).alias("score"))


def mmr_spread(spark, sf_dir):
    """With little weight on relevance."""
    _, picks = _picks(spark, sf_dir, 0.3)
    return picks.select("query_id", "pick", "chunk_id", F.round("score", 6).alias("score"))


# -- context and answers ------------------------------------------------------------------


def context_ranges(spark, sf_dir):
    _, picks = _picks(spark, sf_dir)
    return merged_ranges(picks, SETTINGS.neighbour_window).select(
        "query_id",
        "doc_id",
        F.col("first").alias("first_ordinal"),
        F.col("last").alias("last_ordinal"),
        F.round("score", 6).alias("score"),
        F.array_join("chunk_ids", ",").alias("chunk_ids"),
    )


def context_pieces(spark, sf_dir):
    index, picks = _picks(spark, sf_dir)
    ranges = save(merged_ranges(picks, SETTINGS.neighbour_window), "ranges")
    return range_pieces(ranges, index.chunks, SETTINGS).select(
        "query_id", "doc_id", "ordinal", _page(), F.md5("text").alias("text_md5")
    )


def _asked(spark, sf_dir):
    return corpus(spark, sf_dir).ask_many(questions(spark, sf_dir))


def context_text(spark, sf_dir):
    blocks = corpus(spark, sf_dir).index().retrieve(questions(spark, sf_dir))
    return blocks.select("query_id", F.inline_outer("blocks")).select(
        "query_id",
        "n",
        "doc_id",
        "filename",
        _page(),
        F.md5("text").alias("text_md5"),
        F.length("text").alias("n_chars"),
    )


def formatted_context(spark, sf_dir):
    blocks = corpus(spark, sf_dir).index().retrieve(questions(spark, sf_dir))
    return blocks.select("query_id", F.md5(T.format_context(F.col("blocks"))).alias("context_md5"))


def extractive_answers(spark, sf_dir):
    return _asked(spark, sf_dir).select(
        "query_id",
        "mode",
        "answer",
        F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"),
        F.size("sources").alias("n_sources"),
    )


def answer_sources(spark, sf_dir):
    answers = _asked(spark, sf_dir)
    return answers.select("query_id", F.inline_outer("sources")).select(
        "query_id", "n", "document_id", "filename", _page(), "snippet", "cited"
    )


def source_scores(spark, sf_dir):
    """The score that each source card shows."""
    cards = _asked(spark, sf_dir).select("query_id", F.inline_outer("sources"))
    return cards.where(F.col("n").isNotNull()).select("query_id", "n", "document_id", "score")


def history_messages(spark, sf_dir):
    # only the last turns can matter, so no more than those are brought together
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = (
        table(spark, sf_dir, "conversations")
        .withColumn("_age", F.row_number().over(latest))
        .where(F.col("_age") <= lx.HISTORY_TURNS)
    )
    turns = recent.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))
        ).alias("turns")
    )
    history = F.transform(
        "turns", lambda t: F.struct(t.role.alias("role"), t.content.alias("content"))
    )
    rows = turns.select(
        "conv_id", F.posexplode_outer(A.history_messages(history)).alias("position", "m")
    )
    return rows.where(F.col("m").isNotNull()).select(
        "conv_id", "position", "m.role", F.md5("m.content").alias("content_md5")
    )


def retrieval_accuracy(spark, sf_dir):
    """How often the first hit lies in a document that shares a sentence with the question."""
    asked = questions(spark, sf_dir)
    theirs = asked.select(
        "query_id", F.explode_outer(T.sentences(F.col("question"))).alias("sentence")
    )
    ours = documents(spark, sf_dir).select(
        "doc_id", F.explode_outer(T.sentences(F.col("text"))).alias("sentence")
    )
    expected = theirs.distinct().join(ours, "sentence").select("query_id", "doc_id").distinct()
    first = corpus(spark, sf_dir).index().lexical(asked, 1).select(
        "query_id", "doc_id", F.lit(1).alias("hit")
    )
    judged = expected.join(first, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.coalesce(F.max("hit"), F.lit(0)).alias("hit")
    )
    return judged.agg(F.count("*").alias("n_questions"), F.round(F.avg("hit"), 6).alias("accuracy"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_documents,
        tokenize_keep_stopwords,
        fold_accents,
        stem_words,
        char_trigrams,
        jaccard_of_neighbours,
        sentence_split,
        quote_sentence_split,
        clean_text,
        document_paragraphs,
        page_paragraphs,
        word_counts,
        safe_filenames,
        snippets,
        content_hashes,
        citations_in_text,
        upload_checks,
        question_checks,
        dedup_documents,
        ingest_outcomes,
        known_on_second_ingest,
        split_units,
        chunk_documents,
        chunk_documents_small,
        term_frequency,
        document_frequency,
        corpus_totals,
        index_stats,
        store_stats,
        changed_vocabulary,
        changed_stats,
        list_documents,
        document_previews,
        labelled_documents,
        find_by_hash,
        indexed_chunks,
        question_term_list,
        fuzzy_expand,
        bm25_topk,
        bm25_scoped,
        bm25_after_changes,
        bm25_after_compaction,
        readded_documents,
        event_value_ranks,
        dense_ranking,
        dense_chunks,
        dense_scoped,
        hybrid_search,
        rank_fusion,
        mmr_select,
        mmr_spread,
        context_ranges,
        context_pieces,
        context_text,
        formatted_context,
        extractive_answers,
        answer_sources,
        source_scores,
        history_messages,
        retrieval_accuracy,
    )
}
