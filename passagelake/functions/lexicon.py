"""Fixed values every text function depends on.

Results only agree with the published behaviour if these are exactly as given, so
they are kept together and written out plainly.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

# --- fixed values: stop words ---------------------------------------------------
STOPWORDS = tuple(
    """
    a an the and or but if then than that this these those of in on at to for
    from by with without into over under again further is are was were be been
    being am do does did doing have has had having i you he she it we they me
    him her them my your his its our their as so such about above below between
    while during before after up down out off there here when where why how all
    any both each few more most other some only own same too very s t can will
    just should now what which who whom whose
    """.split()
)

# --- fixed values: suffix rules (suffix, replacement, shortest allowed result) ----
SUFFIX_RULES = (
    ("ies", "y", 3),
    ("ied", "y", 3),
    ("sses", "ss", 3),
    ("ing", "", 4),
    ("edly", "", 4),
    ("ed", "", 4),
    ("ly", "", 4),
    ("es", "", 4),
    ("s", "", 4),
)
UNSTEMMED_LENGTH = 4

# --- fixed values: patterns ---------------------------------------------------------
TOKEN_PATTERN = "[a-z0-9]+(?:['’][a-z]+)?"
SENTENCE_ENDS = ".!?;:"
SENTENCE_STARTS = "A-Z0-9•(\\[\"'-"

# --- fixed values: ranking ------------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
RRF_K = 60
FUZZY_MIN_SIMILARITY = 0.45
FUZZY_MAX_EXPANSIONS = 3
FUZZY_WEIGHT = 0.45
SHORT_QUESTION_TERMS = 2

# --- fixed values: limits and messages ------------------------------------------------
MAX_BLOCK_CHARS = 6000
SNIPPET_CHARS = 260
MAX_ERROR_CHARS = 2000
MAX_NAME_CHARS = 200
MAX_QUESTION_CHARS = 2000
MAX_TURN_CHARS = 8000
TOO_LONG_QUESTION = "question is too long"
TOO_LONG_TURN = "content is too long"
WRONG_TOP_K = "top_k is out of range"
MAX_TOP_K = 20
OVERLAP_SEARCH = (5, 60)
HISTORY_TURNS = 6
MAX_REWRITE_CHARS = 400
EXTRACTIVE_BLOCKS = 4
EXTRACTIVE_PICKS = 3
EXTRACTIVE_MIN_WORDS = 8
EXTRACTIVE_FALLBACK_CHARS = 400
PREVIEW_CHUNKS = 12
SUPPORTED_EXTENSIONS = (".docx", ".md", ".pdf", ".txt")
NO_MATCH_ANSWER = (
    "I could not find anything about that in the uploaded documents. "
    "Try rephrasing the question, or upload a document that covers the topic."
)
NO_PASSAGE_ANSWER = "No relevant passage was found in the uploaded documents."
EXTRACTIVE_WARNING = (
    "Generated answers are disabled; showing the closest passages instead."
)

# White space as Unicode-aware tools see it; spelled out because the regular
# expression engines in use disagree about what \s covers.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

CITATION_PATTERN = rf"\[(\d+(?:[{SPACE_CLASS}]*,[{SPACE_CLASS}]*\d+)*)\]"


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Accent and compatibility folding, derived from the Unicode database.

    Returns ``(source, target, expansions)``: ``source``/``target`` drive one
    ``translate`` call (characters beyond ``len(target)`` are deleted), and
    ``expansions`` lists characters that unfold to several. Only characters whose
    folded form can occur in a token matter; every other one separates tokens
    before and after folding alike.
    """
    token_chars = set("abcdefghijklmnopqrstuvwxyz0123456789'’")
    source, target, deleted, expansions = [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if not (unicodedata.decomposition(char) or unicodedata.combining(char)):
            continue
        folded = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if not folded:
            deleted.append(char)
        elif token_chars.intersection(folded):
            if len(folded) == 1:
                source.append(char)
                target.append(folded)
            else:
                expansions.append((char, folded))
    return "".join(source + deleted), "".join(target), tuple(expansions)


def covering_ranges(chars, gap: int = 64) -> str:
    """A short character class covering ``chars``; neighbours within ``gap`` join up."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges)
