"""The same results as plain SQL over the given tables, for checking in DuckDB.

Every query is a chain of common table expressions built from the raw tables; nothing
comes from what Spark wrote.
"""

from __future__ import annotations

from ..config import Settings
from ..functions import lexicon as lx

S = Settings()
SP = lx.SPACE_CLASS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = "(" + " || ".join(f"chr({ord(c)})" for c in lx.WHITESPACE) + ")"
STOP = "(" + ", ".join(_text(w) for w in lx.STOPWORDS) + ")"
TOKEN = _text(lx.TOKEN_PATTERN)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({strip(x)}, '[{SP}]+'), lambda w: w <> '')"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def raw_tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, {TOKEN})"


def stem(w: str) -> str:
    cases = [f"WHEN length({w}) <= {lx.UNSTEMMED_LENGTH} THEN {w}"]
    for suffix, replacement, shortest in lx.SUFFIX_RULES:
        kept = f"length({w}) - {len(suffix)}"
        result = f"left({w}, {kept})" + (f" || '{replacement}'" if replacement else "")
        cases.append(
            f"WHEN ends_with({w}, '{suffix}') AND {kept} + {len(replacement)} >= {shortest} "
            f"THEN {result}"
        )
    return f"CASE {' '.join(cases)} ELSE {w} END"


def tokens(x: str, keep: bool = False) -> str:
    raw = raw_tokens(x)
    if not keep:
        raw = f"list_filter({raw}, lambda t: t NOT IN {STOP})"
    return f"list_transform({raw}, lambda t: {stem('t')})"


def grams(t: str) -> str:
    padded = f"('$' || {t} || '$')"
    return (
        f"CASE WHEN length({padded}) <= 3 THEN [{padded}] ELSE list_distinct("
        f"list_transform(range(1, length({padded}) - 1), lambda i: substr({padded}, i, 3))) END"
    )


def clean(x: str) -> str:
    plain = f"replace(replace({x}, chr(160), ' '), chr(0), '')"
    joined = rf"regexp_replace({plain}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    return strip(rf"regexp_replace({joined}, '[ \t\r\f\x0b]+', ' ', 'g')")


def paragraphs(x: str) -> str:
    lines = f"[{strip('l')} for l in string_split(p, chr(10)) if {strip('l')} <> '']"
    return (
        rf"list_filter(list_transform(string_split_regex({clean(x)}, '\n[{SP}]*\n+'), "
        f"lambda p: array_to_string({lines}, ' ')), lambda p: p <> '')"
    )


def sentences(x: str) -> str:
    start = lx.SENTENCE_STARTS.replace("'", "''")
    marked = (
        rf"regexp_replace({strip(x)}, '([{lx.SENTENCE_ENDS}])[{SP}]+([{start}])', "
        rf"'\1' || chr(1) || '\2', 'g')"
    )
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), "
        "lambda s: s <> '')"
    )


def quote_sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?])[{SP}]+', '\1' || chr(1), 'g')"
    return f"list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')})"


def snippet(x: str) -> str:
    body = strip(x)
    n = lx.SNIPPET_CHARS
    return (
        f"CASE WHEN length({body}) > {n} "
        rf"THEN regexp_replace(left({body}, {n}), ' [^ ]*\z', '') || '...' ELSE {body} END"
    )


def steady(x: str) -> str:
    return f"(floor(({x}) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE)"


def with_(*parts: str, recursive: bool = True) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# -- building blocks ----------------------------------------------------------------------

DOCS = "docs AS (SELECT doc_id::VARCHAR AS doc_id, doc_id AS num, text FROM documents)"
KEPT = """kept AS (
  SELECT doc_id::VARCHAR AS doc_id, doc_id AS num, text, sha256(text) AS sha
  FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1)"""
# the corpus after English first, everything second, toxic ones deleted
CHANGED = """kept AS (
  SELECT doc_id::VARCHAR AS doc_id, doc_id AS num, text, sha256(text) AS sha FROM (
    SELECT * FROM documents QUALIFY row_number() OVER (
      PARTITION BY sha256(text) ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) = 1)
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""

# English in four parts, everything after it, toxic ones deleted
COMPACTED = CHANGED.replace("WHEN lang = 'en' THEN 0 ELSE 1 END", "WHEN lang = 'en' THEN doc_id % 4 ELSE 4 END")


def units(source: str, limit: int) -> str:
    return f"""paras AS (
  SELECT doc_id, p, generate_subscripts(p, 1) AS pi FROM (
    SELECT doc_id, {paragraphs('text')} AS p FROM {source})),
sents AS (
  SELECT doc_id, pi, s, generate_subscripts(s, 1) AS si FROM (
    SELECT doc_id, pi, {sentences('p[pi]')} AS s FROM paras)),
worded AS (SELECT doc_id, pi, si, s[si] AS sentence, {words('s[si]')} AS w FROM sents),
sliced AS (
  SELECT doc_id, pi, si, 0 AS start, sentence AS text, len(w) AS n FROM worded WHERE len(w) <= {limit}
  UNION ALL
  SELECT doc_id, pi, si, start, array_to_string(w[start + 1:start + {limit}], ' '),
         least({limit}, len(w) - start)
  FROM (SELECT *, unnest(range(0, len(w), {limit})) AS start FROM worded WHERE len(w) > {limit})),
units AS (
  SELECT doc_id, text, n::BIGINT AS n,
         row_number() OVER w - 1 AS i,
         (sum(n) OVER w - n)::BIGINT AS before
  FROM sliced WINDOW w AS (PARTITION BY doc_id ORDER BY pi, si, start ROWS UNBOUNDED PRECEDING))"""


def chunks(source: str, target: int = 180, overlap: int = 45) -> str:
    target = max(40, target)
    overlap = max(0, min(overlap, target // 2))
    smallest = max(20, target // 3)
    # holds because a carried tail is always shorter than the smallest chunk
    assert overlap < smallest
    return (
        units(source, int(target * 1.5))
        + f""",
tails AS (
  SELECT u.doc_id, u.i, min(k.i) AS j FROM units u JOIN units k
    ON k.doc_id = u.doc_id AND k.i <= u.i AND u.before - k.before <= {overlap}
  GROUP BY ALL),
nexts AS (
  SELECT t.doc_id, t.i, t.j, min(v.i) AS stop
  FROM tails t JOIN units b ON b.doc_id = t.doc_id AND b.i = t.j
  LEFT JOIN units v ON v.doc_id = t.doc_id AND v.i > t.i
    AND v.before - b.before >= {smallest} AND v.before + v.n - b.before > {target}
  GROUP BY ALL),
cuts AS (
  SELECT doc_id, 0 AS ordinal, j, stop FROM nexts WHERE i = 0
  UNION ALL
  SELECT c.doc_id, c.ordinal + 1, n.j, n.stop
  FROM cuts c JOIN nexts n ON n.doc_id = c.doc_id AND n.i = c.stop),
chunks AS (
  SELECT c.doc_id || ':' || c.ordinal AS chunk_id, c.doc_id, c.ordinal::INTEGER AS ordinal,
         NULL::INTEGER AS page, string_agg(u.text, ' ' ORDER BY u.i) AS text,
         sum(u.n)::INTEGER AS n_words
  FROM cuts c JOIN units u
    ON u.doc_id = c.doc_id AND u.i >= c.j AND u.i < coalesce(c.stop, 1000000000)
  GROUP BY c.doc_id, c.ordinal)"""
    )


POSTINGS = f"""tokenised AS (SELECT chunk_id, doc_id, ordinal, {tokens('text')} AS toks FROM chunks),
sized AS (SELECT *, len(toks) AS length FROM tokenised WHERE len(toks) > 0),
postings AS (
  SELECT chunk_id, doc_id, ordinal, length, term, count(*) AS tf
  FROM (SELECT chunk_id, doc_id, ordinal, length, unnest(toks) AS term FROM sized) GROUP BY ALL),
vocabulary AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
totals AS (SELECT count(*) AS n_chunks, sum(length) AS total_len FROM sized)"""

QTERMS = f"""asked AS (SELECT item_id::VARCHAR AS query_id, text AS question FROM benchmark),
qlists AS (SELECT query_id, {tokens('question')} AS toks FROM asked),
qpos AS (
  SELECT query_id, toks[i] AS term, min(i) AS spot FROM (
    SELECT query_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM qlists) GROUP BY ALL),
qterms AS (
  SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY spot) - 1 AS pos
  FROM qpos)"""

EXPAND = f"""wanted AS (SELECT DISTINCT term AS q_term FROM qterms),
wgrams AS (SELECT q_term, len(g) AS q_n, unnest(g) AS gram FROM (
  SELECT q_term, {grams('q_term')} AS g FROM wanted)),
vgrams AS (SELECT term, df, len(g) AS n, unnest(g) AS gram FROM (
  SELECT term, df, {grams('term')} AS g FROM vocabulary)),
shared AS (
  SELECT q_term, term, df, q_n, n, count(*) AS s FROM wgrams JOIN vgrams USING (gram)
  WHERE q_term <> term GROUP BY ALL),
similar_terms AS (
  SELECT q_term, term, df, s::DOUBLE / (q_n + n - s) AS similarity FROM shared),
near AS (
  SELECT * FROM similar_terms WHERE similarity >= {lx.FUZZY_MIN_SIMILARITY}::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY q_term ORDER BY similarity DESC, term DESC)
    <= {lx.FUZZY_MAX_EXPANSIONS}),
expanded AS (
  SELECT q_term, term, 1.0::DOUBLE AS weight, df FROM wanted JOIN vocabulary ON term = q_term
  UNION ALL
  SELECT q_term, term, {lx.FUZZY_WEIGHT}::DOUBLE * similarity, df FROM near)"""

SCOPE = """scope AS (
  SELECT b.item_id::VARCHAR AS query_id, d.doc_id::VARCHAR AS doc_id
  FROM benchmark b JOIN documents o ON o.doc_id = b.item_id JOIN documents d ON d.source = o.source)"""


def bm25(scoped: bool = False, name: str = "lexical", limit: int | None = None) -> str:
    scope = (
        "WHERE query_id NOT IN (SELECT query_id FROM scope) "
        "OR (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM scope)"
        if scoped
        else ""
    )
    b, k1 = lx.BM25_B, lx.BM25_K1
    return f"""weights_{name} AS (
  SELECT query_id, pos, e.term,
         e.weight * ln(1.0::DOUBLE + (n_chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS w
  FROM qterms q JOIN expanded e ON e.q_term = q.term, totals),
groups_{name} AS (SELECT query_id, count(DISTINCT pos) AS n_groups FROM weights_{name} GROUP BY 1),
hits_{name} AS (
  SELECT query_id, pos, chunk_id, doc_id, ordinal,
         w * (tf::DOUBLE * {k1 + 1}::DOUBLE / (tf::DOUBLE + {k1}::DOUBLE * ({1 - b}::DOUBLE
           + {b}::DOUBLE * (length::DOUBLE / (total_len::DOUBLE / n_chunks))))) AS part
  FROM weights_{name} JOIN postings USING (term), totals {scope}),
scores_{name} AS (
  SELECT query_id, chunk_id, doc_id, ordinal, {steady('sum(part)')} AS score
  FROM hits_{name} JOIN groups_{name} USING (query_id)
  GROUP BY query_id, chunk_id, doc_id, ordinal, n_groups
  HAVING count(DISTINCT pos) >= CASE WHEN n_groups <= {lx.SHORT_QUESTION_TERMS} THEN 1 ELSE 2 END),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS rank
  FROM scores_{name} QUALIFY rank <= {limit or S.candidate_k})"""


VECTORS = """vectors AS (SELECT vec_id::VARCHAR AS doc_id, embedding::DOUBLE[] AS v FROM embeddings)"""


def dense(scoped: bool = False) -> str:
    scope = (
        "WHERE q.query_id NOT IN (SELECT query_id FROM scope) "
        "OR (q.query_id, s.doc_id) IN (SELECT (query_id, doc_id) FROM scope)"
        if scoped
        else ""
    )
    return f"""qvectors AS (
  SELECT item_id::VARCHAR AS query_id, v FROM benchmark JOIN vectors ON doc_id = item_id::VARCHAR),
dense AS (
  SELECT q.query_id, s.chunk_id, s.doc_id, s.ordinal,
         {steady('list_dot_product(q.v, c.v)')} AS score,
         row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, s.chunk_id DESC) AS rank
  FROM qvectors q, sized s JOIN vectors c ON c.doc_id = s.doc_id {scope}
  QUALIFY rank <= {S.candidate_k})"""


FUSED = f"""both_lists AS (
  SELECT query_id, chunk_id, doc_id, score, rank, true AS lex FROM lexical
  UNION ALL SELECT query_id, chunk_id, doc_id, score, rank, false FROM dense),
per_chunk AS (
  SELECT query_id, chunk_id, doc_id, sum(1.0::DOUBLE / ({lx.RRF_K} + rank)) AS fused,
         max(score) FILTER (lex) AS lex_score, max(rank) FILTER (lex) AS lex_rank,
         max(rank) FILTER (NOT lex) AS dense_rank
  FROM both_lists GROUP BY ALL),
fused_scores AS (
  SELECT query_id, chunk_id, doc_id, lex_rank, dense_rank,
         CASE WHEN count(dense_rank) OVER (PARTITION BY query_id) > 0 THEN fused ELSE lex_score END AS score
  FROM per_chunk),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, lex_rank NULLS LAST, dense_rank) AS rank
  FROM fused_scores QUALIFY rank <= {S.candidate_k})"""


def mmr(lambda_: float = S.mmr_lambda) -> str:
    k = S.top_k
    parts = [
        f"""pool AS (
  SELECT l.*, list_distinct(s.toks) AS terms,
         max(score) OVER (PARTITION BY query_id) AS best,
         count(*) OVER (PARTITION BY query_id) AS pool_size
  FROM lexical l JOIN sized s USING (chunk_id)),
likeness AS (
  SELECT query_id, a, b, c::DOUBLE / (na + nb - c) AS jaccard FROM (
    SELECT x.query_id, x.rank AS a, y.rank AS b, len(x.terms) AS na, len(y.terms) AS nb,
           len(list_intersect(x.terms, y.terms)) AS c
    FROM pool x JOIN pool y ON x.query_id = y.query_id AND x.rank <> y.rank))""",
        f"picks0 AS (SELECT query_id, rank, 0 AS pick FROM pool WHERE pool_size <= {k} AND false)",
    ]
    for i in range(1, k + 1):
        parts.append(f"""round{i} AS (
  SELECT p.query_id, p.rank, {lambda_}::DOUBLE * (p.score / CASE WHEN p.best = 0 THEN 1 ELSE p.best END)
         - {1.0 - lambda_!r}::DOUBLE * coalesce(max(l.jaccard), 0) AS value
  FROM pool p LEFT JOIN picks{i - 1} s ON s.query_id = p.query_id
  LEFT JOIN likeness l ON l.query_id = p.query_id AND l.a = p.rank AND l.b = s.rank
  WHERE p.pool_size > {k}
    AND (p.query_id, p.rank) NOT IN (SELECT (query_id, rank) FROM picks{i - 1})
  GROUP BY p.query_id, p.rank, p.score, p.best
  QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY value DESC, p.rank) = 1),
picks{i} AS (
  SELECT * FROM picks{i - 1} UNION ALL SELECT query_id, rank, {i} FROM round{i})""")
    parts.append(f"""picks AS (
  SELECT p.query_id, s.pick, p.chunk_id, p.doc_id, p.ordinal, p.score
  FROM pool p JOIN picks{k} s ON s.query_id = p.query_id AND s.rank = p.rank
  UNION ALL
  SELECT query_id, rank, chunk_id, doc_id, ordinal, score FROM pool WHERE pool_size <= {k})""")
    return ",\n".join(parts)


WINDOW = S.neighbour_window
RANGES = f"""flagged AS (
  SELECT *, greatest(0, ordinal - {WINDOW}) AS lo,
         CASE WHEN greatest(0, ordinal - {WINDOW}) > lag(ordinal + {WINDOW}) OVER w + 1 THEN 1 ELSE 0 END AS apart
  FROM picks WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY ordinal)),
islands AS (
  SELECT *, sum(apart) OVER (PARTITION BY query_id, doc_id ORDER BY ordinal) AS island,
         min(pick) OVER (PARTITION BY query_id, doc_id) AS doc_rank
  FROM flagged),
ranges AS (
  SELECT query_id, doc_id, island, min(lo) AS first_ordinal, max(ordinal) + {WINDOW} AS last_ordinal,
         max(score) AS score, string_agg(chunk_id, ',' ORDER BY ordinal) AS chunk_ids,
         min(doc_rank) AS doc_rank
  FROM islands GROUP BY query_id, doc_id, island),
pieces AS (
  SELECT r.query_id, r.doc_id, r.first_ordinal, r.score, r.doc_rank, c.ordinal, c.page, c.text
  FROM ranges r JOIN chunks c
    ON c.doc_id = r.doc_id AND c.ordinal BETWEEN r.first_ordinal AND r.last_ordinal)"""

_short, _long = lx.OVERLAP_SEARCH
BLOCKS = f"""ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, first_ordinal ORDER BY ordinal) AS k,
         {words('text')} AS w FROM pieces),
joined AS (
  SELECT query_id, doc_id, first_ordinal, score, doc_rank, page, k, text AS merged FROM ordered WHERE k = 1
  UNION ALL
  SELECT query_id, doc_id, first_ordinal, score, doc_rank, page, k,
         CASE WHEN seam < len(w) THEN merged || ' ' || array_to_string(w[seam + 1:], ' ') ELSE merged END
  FROM (
    SELECT j.query_id, j.doc_id, j.first_ordinal, j.score, j.doc_rank, j.page, o.k, o.w, j.merged,
           coalesce(list_max([n for n in range({_short}, least(len(o.w), {_long}) + 1)
             if ends_with(j.merged, array_to_string(o.w[1:n], ' '))]), 0) AS seam
    FROM joined j JOIN ordered o ON o.query_id = j.query_id AND o.doc_id = j.doc_id
      AND o.first_ordinal = j.first_ordinal AND o.k = j.k + 1)),
blocks AS (
  SELECT query_id, doc_id, 'doc-' || doc_id || '.txt' AS filename, page, score,
         left({strip('merged')}, {lx.MAX_BLOCK_CHARS}) AS text,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_rank, first_ordinal) AS n
  FROM joined
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, first_ordinal ORDER BY k DESC) = 1)"""

# numbering must follow the choice of the fully joined row, so it is done once more
BLOCKS += """,
numbered AS (
  SELECT query_id, doc_id, filename, page, score, text,
         row_number() OVER (PARTITION BY query_id ORDER BY n) AS n FROM blocks)"""

ANSWERS = f"""qsets AS (
  SELECT query_id, list_distinct(list_filter(toks, lambda t: t NOT IN {STOP})) AS qset FROM qlists),
quoted AS (
  SELECT query_id, n, s, generate_subscripts(s, 1) AS spot FROM (
    SELECT query_id, n, {quote_sentences('text')} AS s FROM numbered WHERE n <= {lx.EXTRACTIVE_BLOCKS})),
measured AS (
  SELECT query_id, n, spot, s[spot] AS sentence, qset, len({words('s[spot]')}) AS nw,
         list_distinct({tokens('s[spot]')}) AS terms
  FROM quoted JOIN qsets USING (query_id)),
scored AS (
  SELECT *, len(list_intersect(qset, terms)) AS overlap,
         (len(list_intersect(qset, terms)) / (1.0::DOUBLE + sqrt(len(terms)::DOUBLE))) / sqrt(n::DOUBLE) AS density
  FROM measured),
best_quotes AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY density DESC, n, spot) AS place
  FROM scored WHERE nw >= {lx.EXTRACTIVE_MIN_WORDS}
    AND overlap >= CASE WHEN len(qset) >= 3 THEN 2 ELSE 1 END
  QUALIFY place <= {lx.EXTRACTIVE_PICKS}),
quotes AS (
  SELECT query_id,
         string_agg(rtrim(sentence, {WS}) || ' [' || n || ']', chr(10) || chr(10) ORDER BY place) AS answer,
         list_sort(list_distinct(list(n))) AS cited
  FROM best_quotes GROUP BY query_id),
counts AS (SELECT query_id, count(*) AS n_sources FROM numbered GROUP BY query_id),
answers AS (
  SELECT a.query_id,
         CASE WHEN f.query_id IS NULL THEN 'no_match' ELSE 'extractive' END AS mode,
         CASE WHEN f.query_id IS NULL THEN {_text(lx.NO_MATCH_ANSWER)}
              WHEN q.query_id IS NULL
              THEN rtrim(left(f.text, {lx.EXTRACTIVE_FALLBACK_CHARS}), {WS}) || ' [1]'
              ELSE q.answer END AS answer,
         CASE WHEN f.query_id IS NULL THEN []::BIGINT[] ELSE coalesce(q.cited, [1]) END AS cited,
         coalesce(c.n_sources, 0)::INTEGER AS n_sources
  FROM asked a LEFT JOIN numbered f ON f.query_id = a.query_id AND f.n = 1
  LEFT JOIN quotes q ON q.query_id = a.query_id LEFT JOIN counts c ON c.query_id = a.query_id)"""

INDEXED = [KEPT, chunks("kept"), POSTINGS]
LEXICAL = [*INDEXED, QTERMS, EXPAND, bm25()]
SELECTED = [*LEXICAL, mmr()]
CONTEXT = [*SELECTED, RANGES, BLOCKS]

_RANKED = "SELECT query_id, rank::INTEGER AS rank, chunk_id, doc_id, round(score, 6) AS score FROM "
_CHUNKS = "SELECT chunk_id, doc_id, ordinal, coalesce(page, 0) AS page, n_words, md5(text) AS text_md5 FROM chunks"
_SUMMARY = (
    "SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_terms, "
    "md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {} AS t FROM docs)"
)


def _positions(key: str, pieces: str, source: str, value: str) -> str:
    return (
        f"SELECT {key}, (i - 1)::INTEGER AS \"position\", {value} FROM (SELECT {key}, p, "
        f"generate_subscripts(p, 1) AS i FROM (SELECT {key}, {pieces} AS p FROM {source}))"
    )


def _file(url: str) -> str:
    parts = f"list_filter(string_split({url}, '/'), lambda p: p <> '' AND p <> '.')"
    masked = rf"""regexp_replace(coalesce({parts}[-1], ''), '[\\/:*?"<>|\x00-\x1f]', '_', 'g')"""
    cut = f"left(trim({masked}, '. '), {lx.MAX_NAME_CHARS})"
    return f"CASE WHEN {cut} = '' THEN 'untitled' ELSE {cut} END"


def _suffix(name: str) -> str:
    return rf"lower(regexp_extract({name}, '(?s)^.+(\.[^.]+)\z', 1))"


_HELD = """SELECT l.doc_id::VARCHAR AS doc_id,
  CASE WHEN d.doc_id IS NULL THEN NULL ELSE 'doc-' || d.doc_id || '.txt' END AS filename,
  coalesce(n_chunks, 0)::INTEGER AS n_chunks, coalesce(n_words, 0)::BIGINT AS n_words,
  d.doc_id IS NOT NULL AS held
FROM labels l LEFT JOIN indexed d ON d.doc_id = l.doc_id::VARCHAR"""
_DOCS_INDEXED = """indexed AS (
  SELECT k.doc_id, any_value(k.text) AS text, any_value(k.sha) AS sha,
         count(*) AS n_chunks, sum(n_words) AS n_words
  FROM kept k JOIN chunks c ON c.doc_id = k.doc_id GROUP BY k.doc_id)"""

ORACLES: dict[str, str] = {
    "tokenize_documents": with_(DOCS) + _SUMMARY.format(tokens("text")),
    "tokenize_keep_stopwords": with_(DOCS) + _SUMMARY.format(tokens("text", keep=True)),
    "fold_accents": with_(DOCS) + f"SELECT doc_id, md5({fold('text')}) AS folded_md5 FROM docs",
    "stem_words": with_(DOCS)
    + f"SELECT word, {stem('word')} AS stem, word IN {STOP} AS stopword FROM "
    f"(SELECT DISTINCT unnest({raw_tokens('text')}) AS word FROM docs)",
    "char_trigrams": with_(*INDEXED)
    + f"SELECT term, len(g)::INTEGER AS n_grams, array_to_string(list_sort(g), '|') AS grams "
    f"FROM (SELECT term, {grams('term')} AS g FROM vocabulary)",
    "jaccard_of_neighbours": with_(
        *INDEXED,
        "sets AS (SELECT doc_id, ordinal, list_distinct(toks) AS terms FROM tokenised)",
    )
    + """SELECT a.doc_id, a.ordinal, round(CASE WHEN len(a.terms) = 0 OR len(b.terms) = 0 THEN 0.0
  ELSE len(list_intersect(a.terms, b.terms))::DOUBLE
    / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))) END, 6) AS similarity
FROM sets a JOIN sets b ON b.doc_id = a.doc_id AND b.ordinal = a.ordinal + 1""",
    "sentence_split": with_(DOCS)
    + _positions("doc_id", sentences("text"), "docs", "p[i] AS sentence"),
    "quote_sentence_split": with_(DOCS)
    + _positions("doc_id", quote_sentences("text"), "docs", "p[i] AS sentence"),
    "clean_text": with_(DOCS)
    + f"SELECT doc_id, length(c)::INTEGER AS n_chars, md5(c) AS cleaned_md5 FROM "
    f"(SELECT doc_id, {clean('text')} AS c FROM docs)",
    "document_paragraphs": with_(DOCS)
    + _positions("doc_id", paragraphs("text"), "docs", "md5(p[i]) AS paragraph_md5"),
    "page_paragraphs": _positions(
        "page_id", paragraphs("html"), "pages", "md5(p[i]) AS paragraph_md5"
    ),
    "word_counts": with_(DOCS) + f"SELECT doc_id, len({words('text')})::INTEGER AS n_words FROM docs",
    "safe_filenames": f"SELECT page_id, filename, {_suffix('filename')} AS extension "
    f"FROM (SELECT page_id, {_file('url')} AS filename FROM pages)",
    "snippets": with_(DOCS) + f"SELECT doc_id, {snippet('text')} AS snippet FROM docs",
    "content_hashes": with_(DOCS)
    + "SELECT doc_id, sha256(text) AS sha256, strlen(text)::INTEGER AS size_bytes FROM docs",
    "citations_in_text": """WITH found AS (
  SELECT conv_id, turn, flatten(list_transform(
    regexp_extract_all(text || ' [' || turn || ', 3] [x] [3,1]', '"""
    + lx.CITATION_PATTERN
    + """', 1), lambda g: list_transform(string_split(g, ','), lambda p: try_cast(trim(p) AS INTEGER)))) AS n
  FROM conversations),
placed AS (
  SELECT conv_id, turn, n[i] AS v, min(i) AS spot FROM (
    SELECT conv_id, turn, n, unnest(range(1, len(n) + 1)) AS i FROM found)
  WHERE n[i] BETWEEN 1 AND 5 GROUP BY ALL)
SELECT conv_id, turn, string_agg(v::VARCHAR, ',' ORDER BY spot) AS cited FROM placed GROUP BY conv_id, turn""",
    "upload_checks": f"""WITH named AS (SELECT page_id, {_file('url')} AS filename, html FROM pages),
typed AS (SELECT *, {_suffix('filename')} AS extension FROM named)
SELECT page_id, filename, extension, strlen(html)::BIGINT AS size_bytes, sha256(html) AS sha256,
  CASE WHEN extension NOT IN ('.docx', '.md', '.pdf', '.txt')
       THEN 'Unsupported file type ''' || CASE WHEN extension = '' THEN '(none)' ELSE extension END
            || '''. Supported: .docx, .md, .pdf, .txt.'
       WHEN strlen(html) = 0 THEN 'The file is empty.'
       WHEN strlen(html) > {S.max_upload_bytes}
       THEN format('File is {{:.1f}} MB; the limit is {S.max_upload_mb} MB.', strlen(html) / 1048576.0) END AS rejected
FROM typed""",
    "question_checks": f"""SELECT conv_id, turn,
  CASE WHEN coalesce(length(text), 0) = 0 THEN 'question is missing'
       WHEN length(text) > {lx.MAX_QUESTION_CHARS} THEN 'question is too long'
       WHEN {strip('text')} = '' THEN 'Question must not be empty.'
       WHEN turn NOT BETWEEN 1 AND {lx.MAX_TOP_K} THEN 'top_k is out of range' END AS question_problem,
  CASE WHEN coalesce(role, '') NOT IN ('user', 'assistant') THEN 'role is unknown'
       WHEN length(text) > {lx.MAX_TURN_CHARS} THEN 'content is too long' END AS turn_problem
FROM conversations""",
    "dedup_documents": with_(KEPT) + "SELECT sha AS sha256, doc_id FROM kept",
    "ingest_outcomes": with_(KEPT)
    + """SELECT 'doc-' || d.doc_id || '.txt' AS filename, k.doc_id,
  CASE WHEN k.num = d.doc_id THEN 'indexed' ELSE 'duplicate' END AS status,
  k.num <> d.doc_id AS duplicate, NULL::VARCHAR AS error
FROM documents d JOIN kept k ON k.sha = sha256(d.text)""",
    "known_on_second_ingest": with_(
        """firsts AS (SELECT doc_id, lang, sha256(text) AS sha FROM documents
  QUALIFY row_number() OVER (PARTITION BY sha256(text)
    ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) = 1)"""
    )
    + """SELECT 'doc-' || d.doc_id || '.txt' AS filename, f.doc_id::VARCHAR AS doc_id,
  CASE WHEN f.lang <> 'en' AND f.doc_id = d.doc_id THEN 'indexed' ELSE 'duplicate' END AS status,
  NOT (f.lang <> 'en' AND f.doc_id = d.doc_id) AS duplicate
FROM documents d JOIN firsts f ON f.sha = sha256(d.text)""",
    "split_units": with_(DOCS, units("docs", 30))
    + 'SELECT doc_id, i::INTEGER AS "position", n::INTEGER AS n_words, md5(text) AS text_md5 FROM units',
    "chunk_documents": with_(DOCS, chunks("docs")) + _CHUNKS,
    "chunk_documents_small": with_(DOCS, chunks("docs", 100, 25)) + _CHUNKS,
    "term_frequency": with_(*INDEXED)
    + "SELECT chunk_id, term, tf::INTEGER AS tf, length::INTEGER AS length FROM postings",
    "document_frequency": with_(*INDEXED) + "SELECT term, df FROM vocabulary",
    "corpus_totals": with_(*INDEXED)
    + "SELECT n_chunks, total_len::BIGINT AS total_len, "
    "round(total_len::DOUBLE / n_chunks, 6) AS average_length FROM totals",
    "index_stats": with_(*INDEXED)
    + "SELECT count(DISTINCT chunk_id) AS chunks, count(DISTINCT doc_id) AS documents, "
    "count(DISTINCT term) AS vocabulary FROM postings",
    "store_stats": with_(*INDEXED)
    + "SELECT (SELECT count(*) FROM kept) AS documents, sum(n_words)::BIGINT AS words, "
    "count(*) AS chunks FROM chunks",
    "changed_vocabulary": with_(CHANGED, chunks("kept"), POSTINGS)
    + "SELECT term, df FROM vocabulary",
    "changed_stats": with_(CHANGED, chunks("kept"), POSTINGS)
    + "SELECT n_chunks, total_len::BIGINT AS total_len, (SELECT count(*) FROM kept) AS documents, "
    "(SELECT sum(n_words)::BIGINT FROM chunks) AS words FROM totals",
    "list_documents": with_(KEPT, chunks("kept"), _DOCS_INDEXED)
    + """SELECT doc_id, 'doc-' || doc_id || '.txt' AS filename, '.txt' AS extension,
  strlen(text)::BIGINT AS size_bytes, 0::INTEGER AS pages, n_chunks::INTEGER AS n_chunks,
  n_words::BIGINT AS n_words, 'indexed' AS status, NULL::VARCHAR AS error,
  '2024-01-01T00:00:00+00:00' AS uploaded_at FROM indexed""",
    "document_previews": with_(KEPT, chunks("kept"))
    + f"""SELECT doc_id, ordinal, coalesce(page, 0) AS page, md5(text) AS text_md5 FROM chunks
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) <= {lx.PREVIEW_CHUNKS}""",
    "labelled_documents": with_(KEPT, chunks("kept"), _DOCS_INDEXED) + _HELD,
    "find_by_hash": with_(KEPT)
    + "SELECT d.doc_id::VARCHAR AS doc_id, k.doc_id AS stored_id "
    "FROM documents d JOIN kept k ON k.sha = sha256(d.text)",
    "indexed_chunks": with_(KEPT, chunks("kept")) + _CHUNKS,
    "question_term_list": with_(QTERMS) + "SELECT query_id, pos::INTEGER AS pos, term FROM qterms",
    "fuzzy_expand": with_(*INDEXED, QTERMS, EXPAND)
    + "SELECT q_term, term, round(weight, 6) AS weight, df FROM expanded",
    "bm25_topk": with_(*LEXICAL) + _RANKED + "lexical",
    "bm25_scoped": with_(*INDEXED, QTERMS, EXPAND, SCOPE, bm25(scoped=True)) + _RANKED + "lexical",
    "bm25_after_changes": with_(CHANGED, chunks("kept"), POSTINGS, QTERMS, EXPAND, bm25())
    + _RANKED
    + "lexical",
    "bm25_after_compaction": with_(COMPACTED, chunks("kept"), POSTINGS, QTERMS, EXPAND, bm25())
    + _RANKED
    + "lexical",
    # what was deleted and added again is there once, whatever was first
    "readded_documents": with_(KEPT, chunks("kept"), _DOCS_INDEXED)
    + "SELECT doc_id, n_chunks::INTEGER AS n_chunks, n_chunks::BIGINT AS n_rows FROM indexed",
    "event_value_ranks": """WITH v AS (
  SELECT event_type, list_sort(list(value)) AS sorted, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, share::DOUBLE AS share, n, sorted[least(floor(share::DOUBLE * n)::BIGINT, n - 1) + 1] AS value
FROM v, (VALUES (0.0), (0.5), (0.95), (0.99), (1.0)) t(share)""",
    "dense_ranking": with_(
        VECTORS,
        """cells AS (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (
    SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL),
means AS (SELECT label::VARCHAR AS query_id, list(x ORDER BY i) AS m FROM cells GROUP BY label)""",
    )
    + f"""SELECT query_id, rank::INTEGER AS rank, doc_id AS chunk_id, doc_id, round(score, 6) AS score FROM (
  SELECT query_id, doc_id,
         {steady('list_dot_product(list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))), v)')} AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank
  FROM means, vectors QUALIFY rank <= {S.candidate_k})""",
    "dense_chunks": with_(*INDEXED, VECTORS, dense()) + _RANKED + "dense",
    "dense_scoped": with_(*INDEXED, VECTORS, SCOPE, dense(scoped=True)) + _RANKED + "dense",
    "hybrid_search": with_(*LEXICAL, VECTORS, dense(), FUSED) + _RANKED + "fused",
    "rank_fusion": with_(
        *INDEXED, QTERMS, EXPAND, SCOPE, bm25(scoped=True), VECTORS, dense(), FUSED
    )
    + _RANKED
    + "fused",
    "mmr_select": with_(*SELECTED)
    + "SELECT query_id, pick::INTEGER AS pick, chunk_id, round(score, 6) AS score FROM picks",
    "mmr_spread": with_(*LEXICAL, mmr(0.3))
    + "SELECT query_id, pick::INTEGER AS pick, chunk_id, round(score, 6) AS score FROM picks",
    "context_ranges": with_(*SELECTED, RANGES)
    + "SELECT query_id, doc_id, first_ordinal::INTEGER AS first_ordinal, "
    "last_ordinal::INTEGER AS last_ordinal, round(score, 6) AS score, chunk_ids FROM ranges",
    "context_pieces": with_(*SELECTED, RANGES)
    + "SELECT query_id, doc_id, ordinal, coalesce(page, 0) AS page, md5(text) AS text_md5 FROM pieces",
    "context_text": with_(*CONTEXT)
    + "SELECT query_id, n::INTEGER AS n, doc_id, filename, coalesce(page, 0) AS page, md5(text) AS text_md5, "
    "length(text)::INTEGER AS n_chars FROM numbered",
    "formatted_context": with_(*CONTEXT)
    + """SELECT query_id, md5(string_agg('[' || n || '] (' || filename || ')' || chr(10) || text,
  chr(10) || chr(10) ORDER BY n)) AS context_md5 FROM numbered GROUP BY query_id""",
    "extractive_answers": with_(*CONTEXT, ANSWERS)
    + "SELECT query_id, mode, answer, array_to_string(cited, ',') AS cited, n_sources FROM answers",
    "answer_sources": with_(*CONTEXT, ANSWERS)
    + f"""SELECT query_id, n::INTEGER AS n, doc_id AS document_id, filename, coalesce(page, 0) AS page,
  {snippet('text')} AS snippet, list_contains(a.cited, n) AS cited
FROM numbered JOIN answers a USING (query_id)""",
    "source_scores": with_(*CONTEXT)
    + "SELECT query_id, n::INTEGER AS n, doc_id AS document_id, round(score, 4) AS score FROM numbered",
    "history_messages": f"""WITH recent AS (
  SELECT conv_id, turn, role, {strip('text')} AS content FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {lx.HISTORY_TURNS}),
valid AS (SELECT * FROM recent WHERE role IN ('user', 'assistant') AND content <> ''),
started AS (
  SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS open FROM valid)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS "position",
  role, md5(content) AS content_md5 FROM started WHERE open = 1""",
    "retrieval_accuracy": with_(
        *INDEXED,
        QTERMS,
        EXPAND,
        bm25(limit=1),
        DOCS,
        f"""theirs AS (SELECT DISTINCT query_id, unnest({sentences('question')}) AS sentence FROM asked),
ours AS (SELECT doc_id, unnest({sentences('text')}) AS sentence FROM docs),
expected AS (SELECT DISTINCT query_id, doc_id FROM theirs JOIN ours USING (sentence)),
judged AS (
  SELECT e.query_id, max(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) AS hit
  FROM expected e LEFT JOIN lexical l ON l.query_id = e.query_id AND l.doc_id = e.doc_id GROUP BY 1)""",
    )
    + "SELECT count(*) AS n_questions, round(avg(hit), 6) AS accuracy FROM judged",
}
