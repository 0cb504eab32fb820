"""Text functions as Column builders.

Everything here is a composition of built-in expressions: no Python runs per row,
and every function works both on a column and inside a higher-order lambda.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

_SPACES = f"[{lx.SPACE_CLASS}]+"
_SENTENCE_GAP = f"(?<=[{lx.SENTENCE_ENDS}])[{lx.SPACE_CLASS}]+(?=[{lx.SENTENCE_STARTS}])"
_QUOTE_GAP = f"(?<=[.!?])[{lx.SPACE_CLASS}]+"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# -- white space --------------------------------------------------------------------


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(lx.WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(lx.WHITESPACE))


def words(text: Column) -> Column:
    """Words between runs of white space; an empty array for blank text."""
    return F.filter(F.split(strip(text), _SPACES, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


# -- tokens -------------------------------------------------------------------------


def fold(text: Column) -> Column:
    """Lower-case, then drop accents and unfold compatibility characters."""
    source, target, expansions = lx.fold_tables()
    lowered = F.lower(text)
    several = "[" + lx.covering_ranges(char for char, _ in expansions) + "]"
    pairs = F.split(F.lit("\u0001".join(char + folded for char, folded in expansions)), "\u0001")
    unfolded = F.aggregate(
        pairs,
        lowered,
        lambda acc, p: F.replace(acc, F.left(p, F.lit(1)), F.substring(p, F.lit(2), F.length(p))),
    )
    # Plain ASCII is by far the most common case and needs neither step.
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, lowered).otherwise(
        F.translate(
            F.when(lowered.rlike(several), unfolded).otherwise(lowered), source, target
        )
    )


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(lx.TOKEN_PATTERN), F.lit(0))


def stem(word: Column) -> Column:
    """Strip one inflectional suffix: the first rule whose result is long enough."""
    rules = F.when(F.length(word) <= lx.UNSTEMMED_LENGTH, word)
    for suffix, replacement, shortest in lx.SUFFIX_RULES:
        kept = F.length(word) - len(suffix)
        result = F.left(word, kept)
        if replacement:
            result = F.concat(result, F.lit(replacement))
        rules = rules.when(
            word.endswith(suffix) & (kept + len(replacement) >= shortest), result
        )
    return rules.otherwise(word)


def is_stopword(word: Column) -> Column:
    return word.isin(*lx.STOPWORDS)


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    raw = raw_tokens(text)
    if not keep_stopwords:
        raw = F.filter(raw, lambda t: ~is_stopword(t))
    return F.transform(raw, stem)


def term_counts(token_list: Column) -> Column:
    """``array<struct<term, tf>>`` of one token array, counted inside the row.

    Sorting brings equal tokens together, so a term's count is the distance between
    the positions where runs begin: no shuffle is needed to count within a chunk.
    """
    def runs(ordered):
        begins = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return bind(
            begins,
            lambda b: F.transform(
                b,
                lambda start, k: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(b, k + 1), F.size(ordered)) - start).alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(token_list) == 0, empty).otherwise(
        bind(F.array_sort(token_list), runs)
    )


def char_ngrams(term: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the term padded with ``$`` on both sides."""
    padded = F.concat(F.lit("$"), term, F.lit("$"))
    grams = F.transform(
        F.sequence(F.lit(1), F.length(padded) - (n - 1)),
        lambda i: F.substring(padded, i, F.lit(n)),
    )
    return F.when(F.length(padded) <= n, F.array(padded)).otherwise(F.array_distinct(grams))


def jaccard(left: Column, right: Column) -> Column:
    """Set similarity of two arrays that hold no value twice."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        shared.cast("double") / total
    )


# -- sentences and paragraphs ----------------------------------------------------------


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(
        F.transform(F.split(text, pattern, -1), strip), lambda piece: piece != ""
    )


def sentences(text: Column) -> Column:
    return _pieces(strip(text), _SENTENCE_GAP)


def quote_sentences(text: Column) -> Column:
    """The coarser split used when quoting: full stops, exclamation, question marks.

    Unlike :func:`sentences` empty pieces stay, so positions match the split.
    """
    return F.transform(F.split(text, _QUOTE_GAP, -1), strip)


def clean(text: Column) -> Column:
    """Normalise one page: plain spaces, no NUL, hyphenated line breaks repaired."""
    plain = F.translate(text, "\u00a0\u0000", " ")
    joined = F.regexp_replace(plain, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    return strip(F.regexp_replace(joined, r"[ \t\r\f\x0b]+", " "))


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs, each with its lines joined by one space."""
    def one_line(paragraph):
        return F.array_join(_pieces(paragraph, "\n"), " ")

    split = F.split(clean(text), rf"\n[{lx.SPACE_CLASS}]*\n+", -1)
    return F.filter(F.transform(split, one_line), lambda p: p != "")


# -- names, ids, snippets ------------------------------------------------------------


def base_name(name: Column) -> Column:
    """Last path component; a lone ``.`` component counts as no name."""
    parts = F.filter(F.split(name, "/", -1), lambda p: (p != "") & (p != "."))
    return F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))


def safe_filename(name: Column) -> Column:
    masked = F.regexp_replace(
        base_name(F.coalesce(name, F.lit(""))), r'[\\/:*?"<>|\x00-\x1f]', "_"
    )
    cut = F.left(F.trim(masked, F.lit(". ")), F.lit(lx.MAX_NAME_CHARS))
    return F.when(cut == "", F.lit("untitled")).otherwise(cut)


def extension(name: Column) -> Column:
    """Lower-cased suffix from the last dot; none for a leading or trailing dot."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1))


def ordinal_of(chunk_id: Column) -> Column:
    last = F.element_at(F.split(chunk_id, ":", -1), -1)
    return F.when(
        chunk_id.contains(":"), F.coalesce(last.try_cast("int"), F.lit(0))
    ).otherwise(F.lit(0))


def snippet(text: Column) -> Column:
    body = strip(text)
    cut = F.regexp_replace(F.left(body, F.lit(lx.SNIPPET_CHARS)), r" [^ ]*\z", "")
    return F.when(F.length(body) > lx.SNIPPET_CHARS, F.concat(cut, F.lit("..."))).otherwise(body)


def citations(text: Column, limit: Column) -> Column:
    """Cited excerpt numbers within ``1..limit``, in order of first appearance."""
    groups = F.regexp_extract_all(text, F.lit(lx.CITATION_PATTERN), F.lit(1))
    numbers = F.flatten(
        F.transform(
            groups,
            lambda g: F.transform(F.split(g, ",", -1), lambda p: strip(p).try_cast("int")),
        )
    )
    return F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= limit)))


def join_without_overlap(pieces: Column) -> Column:
    """Concatenate neighbouring chunks, dropping text repeated at each seam."""
    shortest, longest = lx.OVERLAP_SEARCH

    def seam(merged, piece):
        def joined(word_list):
            sizes = F.when(
                F.size(word_list) >= shortest,
                F.sequence(F.least(F.size(word_list), F.lit(longest)), F.lit(shortest), F.lit(-1)),
            ).otherwise(F.array().cast("array<int>"))
            repeated = F.coalesce(
                F.get(
                    F.filter(
                        sizes,
                        lambda n: merged.endswith(F.array_join(F.slice(word_list, F.lit(1), n), " ")),
                    ),
                    F.lit(0),
                ),
                F.lit(0),
            )
            return bind(
                repeated,
                lambda r: F.when(
                    r < F.size(word_list),
                    F.concat(
                        merged,
                        F.lit(" "),
                        F.array_join(
                            F.slice(word_list, r + 1, F.size(word_list)), " "
                        ),
                    ),
                ).otherwise(merged),
            )

        return bind(words(piece), joined)

    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return strip(F.aggregate(rest, F.get(pieces, F.lit(0)), seam))


def format_context(blocks: Column) -> Column:
    """Numbered, attributed excerpts from ``array<struct<filename,page,text,...>>``."""
    def excerpt(block, i):
        place = F.when(
            F.coalesce(block.page, F.lit(0)) != 0,
            F.concat(block.filename, F.lit(", page "), block.page.cast("string")),
        ).otherwise(block.filename)
        return F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] ("), place, F.lit(")\n"), block.text
        )

    return F.array_join(F.transform(blocks, excerpt), "\n\n")
