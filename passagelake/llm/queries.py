"""The registered queries of the operators: each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, quality_pu, toxicity
from .chat import read_digests, written_turns
from .common import table
from .decontaminate import contaminated, scan
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack
from .phrases import collocations
from .quality_rules import judge
from .records import read_records, record_folder, write_records
from .warc import archive_folder, read_archives, write_archives
from .whitening import whiten


def op1_line_dedup(spark, sf_dir) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).select(
        "_row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def _remainder(column: str, by: int):
    """What the checksum of an id, as text, leaves when divided (null ids: 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % by, F.lit(0))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: the conversation added to the table: texts that hold the template's own marks
TRAP = r"\### Assistant: </turn> ok"


def op2_chat(spark, sf_dir) -> DataFrame:
    added = spark.createDataFrame(
        [(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    path = vocabulary("byte_bpe_50k.json")
    return read_digests(written_turns(rows, path), path)


def packed_pieces(documents: DataFrame) -> DataFrame:
    pieces = pack(documents, vocabulary("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_packing(spark, sf_dir) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir) -> DataFrame:
    folder = archive_folder(spark)
    index = write_archives(table(spark, sf_dir, "pages"), folder, least_bytes=100)
    return read_archives(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_toxicity(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = toxicity.toxic_labels(table(spark, sf_dir, "labels")).where(_remainder("id", 4) != 2)
    return toxicity.scored(documents, toxicity.fit(documents, labels)).select(
        F.col("id").alias("doc_id"), (_remainder("id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op8_token_records(spark, sf_dir) -> DataFrame:
    folder = record_folder(spark)
    files = write_records(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_records(spark, folder, files).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op4_quality_rules(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def quality_scores(spark, sf_dir, documents) -> tuple[DataFrame, quality_pu.Model]:
    """The feature table of some documents, and the model fitted to them and to the labels."""
    described = quality_pu.features(documents)
    may_learn = _remainder("id", 3) != 1
    trusted = quality_pu.trusted_ids(table(spark, sf_dir, "labels"), "quality").where(may_learn)
    return described, quality_pu.fit(described, trusted, may_learn)


def op9_quality_classifier(spark, sf_dir) -> DataFrame:
    described, model = quality_scores(spark, sf_dir, table(spark, sf_dir, "documents"))
    return quality_pu.scored(described, model).select(
        F.col("id").alias("doc_id"), (_remainder("id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_decontamination(spark, sf_dir) -> DataFrame:
    scanned = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13)
    return scanned.select(
        "_row.doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(20).alias("contaminated"),
    )


def op11_whitening(spark, sf_dir) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=16)


def op12_bpe(spark, sf_dir) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op13_phrases(spark, sf_dir) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), max_words=3, min_count=10, covered=50, top=2000)


QUERIES = {q.__name__: q for q in (op1_line_dedup, op2_chat, op3_packing, op4_quality_rules, op5_warc, op6_near_dedup, op7_toxicity, op8_token_records, op9_quality_classifier, op10_decontamination,
    op11_whitening, op12_bpe, op13_phrases)}

ORACLES = {
    "op1_line_dedup": r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
), lines AS (
    SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs
), keys AS (
    SELECT r, doc_id, pos, line,
        translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), frequent AS (
    SELECT k FROM keys WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
    SELECT r, doc_id, pos, line, k IN (SELECT k FROM frequent) AS dropped FROM keys
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
""",
    "op4_quality_rules": r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), windows AS (
    SELECT r, unnest(range(len(w) - 7)) AS p, w FROM docs WHERE len(w) >= 8
), grams AS (
    SELECT r, p, count(*) OVER (PARTITION BY r, array_to_string(w[p + 1 : p + 8], ' ')) AS n FROM windows
), hit AS (
    SELECT r, count(DISTINCT p + k) AS n FROM grams, range(8) t(k) WHERE n > 1 GROUP BY r
), f AS (
    SELECT docs.r, doc_id, lang, source, len(w)::BIGINT AS n_words,
        length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
        coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
        len(w) < 20 OR 100 * coalesce(hit.n, 0) > 30 * len(w) AS base_failed
    FROM docs LEFT JOIN hit USING (r)
), v AS (
    SELECT lang, source, 'symbols' AS rule, n_symbols / word_chars AS v FROM f WHERE n_words > 0 AND NOT base_failed
    UNION ALL SELECT lang, source, 'repeats', n_repeat_words / n_words FROM f WHERE n_words > 0 AND NOT base_failed
    UNION ALL SELECT lang, source, 'lines', n_dup_lines / n_lines FROM f WHERE n_words > 0 AND NOT base_failed
    UNION ALL SELECT lang, source, 'word_length', word_chars / n_words FROM f WHERE n_words > 0 AND NOT base_failed
), b AS (
    SELECT lang, source, rule, CASE WHEN v > 0 THEN ceil(ln(v) / ln(1.02))::INT ELSE -1000000 END AS bin, count(*) AS n
    FROM v GROUP BY ALL
), level AS (
    SELECT 2 AS g, lang, source, rule, bin, sum(n) AS n FROM b GROUP BY ALL
    UNION ALL SELECT 1, lang, '', rule, bin, sum(n) FROM b GROUP BY ALL
    UNION ALL SELECT 0, '', '', rule, bin, sum(n) FROM b GROUP BY ALL
), ranked AS (
    SELECT g, lang, source, rule, CASE WHEN bin = -1000000 THEN 0 ELSE 2 * pow(1.02, bin) / 2.02 END AS v,
        sum(n) OVER (PARTITION BY g, lang, source, rule ORDER BY bin) AS upto,
        sum(n) OVER (PARTITION BY g, lang, source, rule) AS total
    FROM level
), q AS (
    SELECT g, lang, source, rule, max(total) AS n,
        min(v) FILTER (upto >= 0.05::DOUBLE * total) AS low, min(v) FILTER (upto >= 0.5 * total) AS mid,
        min(v) FILTER (upto >= 0.95::DOUBLE * total) AS high,
        min(v) FILTER (upto >= 0.98::DOUBLE * total) AS top
    FROM ranked GROUP BY ALL
), chosen AS (
    SELECT o.lang, o.source, o.rule,
        CASE WHEN o.n >= 200 THEN o.low WHEN m.n >= 200 THEN m.low ELSE a.low END AS low,
        CASE WHEN o.n >= 200 THEN o.mid WHEN m.n >= 200 THEN m.mid ELSE a.mid END AS mid,
        CASE WHEN o.n >= 200 THEN o.high WHEN m.n >= 200 THEN m.high ELSE a.high END AS high,
        CASE WHEN o.n >= 200 THEN o.top WHEN m.n >= 200 THEN m.top ELSE a.top END AS top
    FROM q o JOIN q m ON m.g = 1 AND m.lang = o.lang AND m.rule = o.rule JOIN q a ON a.g = 0 AND a.rule = o.rule
    WHERE o.g = 2
), fence AS (
    SELECT lang, source,
        max(mid + 4 * (mid - low) + 0.03::DOUBLE + least(0.25::DOUBLE * (high - mid), 0.03::DOUBLE)) FILTER (rule = 'symbols') AS symbols,
        max(mid + 4 * (mid - low) + 0.15::DOUBLE + least(2 * (top - mid), 0.15::DOUBLE)) FILTER (rule = 'repeats') AS repeats,
        max(mid + 4 * (mid - low) + 0.2::DOUBLE + least(2 * (top - mid), 0.3::DOUBLE)) FILTER (rule = 'lines') AS lines,
        max(mid + 4 * (mid - low) + 2 + least(2 * (high - mid), 1)) FILTER (rule = 'word_length') AS longest,
        min(mid - 4 * (high - mid) - 2) FILTER (rule = 'word_length') AS shortest
    FROM chosen GROUP BY ALL
), judged AS (
    SELECT * FROM f LEFT JOIN fence USING (lang, source)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    coalesce(NOT base_failed AND n_symbols / word_chars <= symbols AND n_repeat_words / n_words <= repeats
        AND n_dup_lines / n_lines <= lines AND word_chars / n_words BETWEEN shortest AND longest, false) AS kept
FROM judged
""",
    "op10_decontamination": r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), grams AS (
    SELECT DISTINCT item, l, array_to_string(w[p + 1 : p + l], ' ') AS gram
    FROM (SELECT item, w, least(len(w), 13) AS l, unnest(range(greatest(len(w) - 12, 1))) AS p FROM item WHERE len(w) > 0)
), lengths AS (
    SELECT DISTINCT l FROM grams
), windows AS (
    SELECT r, l, p, array_to_string(w[p + 1 : p + l], ' ') AS gram
    FROM (SELECT r, w, l, unnest(range(len(w) - l + 1)) AS p FROM docs, lengths WHERE len(w) >= l)
), hit AS (
    SELECT r, l, p, item FROM windows JOIN grams USING (l, gram)
), words AS (
    SELECT r, count(DISTINCT p + k) AS n FROM (SELECT r, p, unnest(range(l)) AS k FROM (SELECT DISTINCT r, l, p FROM hit)) GROUP BY r
), found AS (
    SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n > 0 AND 20 * words.n >= len(w), false) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
""",
    "op2_chat": r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(4 + length(role) + 2 + length(text) + 8 + length(text) - length(replace(text, '\', ''))
        + (length(text) - length(replace(text, '</turn>', ''))) // 7
        + len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '###')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
""",
    "op5_warc": r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
    SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p
), first AS (
    SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN first_id <> page_id OR (page_id IS NULL AND first_id IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_id <> page_id OR (page_id IS NULL AND first_id IS NOT NULL) THEN first_id END AS refers_to
FROM h LEFT JOIN first USING (payload_digest)
""",
    "op13_phrases": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), parts AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS MATERIALIZED (
    SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, 1 AS k, unnest(w) AS phrase FROM parts
        UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda p: array_to_string(w[p : p + 1], ' '))) FROM parts
        UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p : p + 2], ' '))) FROM parts
    ) GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), counts AS MATERIALIZED (
    SELECT lang || chr(9) || phrase AS key, f FROM grams WHERE f >= 10
), candidates AS MATERIALIZED (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10
), cuts AS (
    SELECT lang, phrase, a, 1 AS c, lang || chr(9) || w[1] AS first, lang || chr(9) || array_to_string(w[2 :], ' ') AS rest
    FROM candidates
    UNION ALL SELECT lang, phrase, a, 2, lang || chr(9) || array_to_string(w[: 2], ' '), lang || chr(9) || w[3]
    FROM candidates WHERE k = 3
), lefts AS MATERIALIZED (
    SELECT cuts.*, f AS l FROM cuts JOIN counts ON key = first
), scored AS MATERIALIZED (
    SELECT lang, phrase, a, c, l, f AS r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * f))::BIGINT AS score
    FROM lefts JOIN counts ON key = rest
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), longer AS (
    SELECT key, max(a) AS a FROM (
        SELECT a, unnest([lang || chr(9) || array_to_string(w[1 : 2], ' '), lang || chr(9) || array_to_string(w[2 : 3], ' ')]) AS key
        FROM candidates WHERE k = 3
    ) GROUP BY key
), kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN longer ON key = lang || chr(9) || phrase
    WHERE longer.a IS NULL OR 100 * longer.a < 50 * lowest.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}
