from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from passagelake.functions import lexicon as lx
from passagelake.functions import text as T


def one(spark, value, expression):
    frame = spark.createDataFrame([(value,)], "x string")
    return frame.select(expression(F.col("x"))).first()[0]


def listed(spark, value, expression):
    found = one(spark, value, expression)
    return None if found is None else list(found)


def test_tokens_fold_case_accents_and_suffixes(spark):
    assert listed(spark, "Résumé RESPONSIBILITIES", T.tokens) == ["resume", "responsibility"]
    assert listed(spark, "The crew's cats weren’t hurrying", T.tokens) == [
        "crew'", "cats", "weren’t", "hurry",
    ]
    assert listed(spark, "of the and", T.tokens) == []
    assert listed(spark, "of Boxes", lambda x: T.tokens(x, True)) == ["of", "boxe"]


@pytest.mark.parametrize(
    "word,expected",
    [
        ("policies", "policy"), ("was", "was"), ("boxes", "boxe"), ("process", "proces"),
        ("processes", "process"), ("ties", "ties"), ("married", "marry"), ("string", "string"),
        ("testing", "test"), ("reportedly", "report"), ("quickly", "quick"), ("used", "used"),
        ("classes", "class"), ("glasses", "glass"), ("dies", "dies"), ("bring", "bring"),
    ],
)
def test_stem(spark, word, expected):
    assert one(spark, word, T.stem) == expected


def test_folding_agrees_with_the_unicode_database(spark):
    """Every character, between two letters, yields the tokens its decomposition does."""
    codes = [c for c in range(0x20, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b {chr(c)}" for c in codes]
    frame = spark.createDataFrame([(c, t) for c, t in zip(codes, texts)], "c int, x string")
    got = {r["c"]: r["t"] for r in frame.select("c", T.raw_tokens(F.col("x")).alias("t")).collect()}
    wrong = []
    for code, text in zip(codes, texts):
        plain = unicodedata.normalize("NFKD", text.lower())
        plain = "".join(c for c in plain if not unicodedata.combining(c))
        if re.findall(lx.TOKEN_PATTERN, plain) != list(got[code]):
            wrong.append(hex(code))
    # the JVM may know characters from a newer or older Unicode version
    assert len(wrong) <= 5, wrong


def test_term_counts_match_a_plain_count(spark):
    text = "bee bee hive Bees swarm hive bee a"
    counts = one(spark, text, lambda x: T.term_counts(T.tokens(x)))
    assert {c["term"]: c["tf"] for c in counts} == {"bee": 3, "hive": 2, "bees": 1, "swarm": 1}
    assert one(spark, "of the", lambda x: T.term_counts(T.tokens(x))) == []


def test_char_ngrams(spark):
    assert listed(spark, "a", T.char_ngrams) == ["$a$"]
    assert listed(spark, "ab", T.char_ngrams) == ["$ab", "ab$"]
    assert listed(spark, "aaaa", T.char_ngrams) == ["$aa", "aaa", "aa$"]


def test_jaccard_of_empty_sets_is_zero(spark):
    frame = spark.createDataFrame([([], ["a"]), (["a", "b"], ["b", "c"])], "l array<string>, r array<string>")
    got = [r[0] for r in frame.select(T.jaccard(F.col("l"), F.col("r"))).collect()]
    assert got == [0.0, pytest.approx(1 / 3)]


def test_sentences(spark):
    text = " One ends here. Two follows! three stays; Four: (Five) is\u00a0it.\u00a0- dash. École stays. 6 "
    assert listed(spark, text, T.sentences) == [
        "One ends here.", "Two follows! three stays;", "Four:", "(Five) is\u00a0it.",
        "- dash. École stays.", "6",
    ]
    assert listed(spark, "  \n ", T.sentences) == []


def test_clean_and_paragraphs(spark):
    assert one(spark, "a\u00a0b\u0000c objec-\ntive \t x\n y ", T.clean) == "a bc objective x\n y"
    text = "first line\n second line \n \n\u00a0\nnext\n\n\nlast -\nend"
    assert listed(spark, text, T.paragraphs) == ["first line second line", "next", "last - end"]
    assert listed(spark, " \n\n ", T.paragraphs) == []


def test_word_count_knows_unicode_spaces(spark):
    assert one(spark, "\u2003one\u00a0two\u3000three\x1ffour ", T.word_count) == 4
    assert one(spark, " \t", T.word_count) == 0


@pytest.mark.parametrize(
    "name,safe,suffix",
    [
        ("../../etc/passwd.txt", "passwd.txt", ".txt"),
        ("C:\\docs\\a?.PDF", "C__docs_a_.PDF", ".pdf"),
        ("folder/", "folder", ""),
        ("..", "untitled", ""),
        (".hidden", "hidden", ""),
        ("", "untitled", ""),
        ("x" * 210 + ".txt", "x" * 200, ""),
        ("a.b.Md ", "a.b.Md", ".md"),
    ],
)
def test_names(spark, name, safe, suffix):
    assert one(spark, name, T.safe_filename) == safe
    assert one(spark, safe, T.extension) == suffix


def test_missing_name(spark):
    assert one(spark, None, T.safe_filename) == "untitled"


def test_ordinal_of(spark):
    ids = {"doc:7": 7, "a:b:12": 12, "doc": 0, "doc:x": 0, "": 0}
    for chunk_id, ordinal in ids.items():
        assert one(spark, chunk_id, T.ordinal_of) == ordinal


def test_snippet(spark):
    assert one(spark, " short ", T.snippet) == "short"
    long = "word " * 60
    assert one(spark, long, T.snippet) == " ".join(["word"] * 52) + "..."
    assert one(spark, "x" * 300, T.snippet) == "x" * 260 + "..."


def test_citations(spark):
    text = "Yes [1, 3]. No [0] [99] [x] [3,\u00a02] [1]"
    assert listed(spark, text, lambda x: T.citations(x, F.lit(3))) == [1, 3, 2]
    assert listed(spark, "none", lambda x: T.citations(x, F.lit(3))) == []


@pytest.mark.parametrize("shared,dropped", [(4, False), (5, True), (60, True), (61, False)])
def test_seams(spark, shared, dropped):
    seam = [f"s{i}" for i in range(shared)]
    left, right = " ".join(["left", *seam]), " ".join([*seam, "right"])
    frame = spark.createDataFrame([([left, right],)], "p array<string>")
    got = frame.select(T.join_without_overlap(F.col("p"))).first()[0]
    expected = ["left", *seam, "right"] if dropped else ["left", *seam, *seam, "right"]
    assert got == " ".join(expected)


def test_a_repeated_piece_adds_nothing(spark):
    piece = "one two three four five six"
    frame = spark.createDataFrame([([piece, piece],), ([],), ([" only "],)], "p array<string>")
    got = [r[0] for r in frame.select(T.join_without_overlap(F.col("p"))).collect()]
    assert got[0] == piece and got[2] == "only"


def test_format_context(spark):
    rows = [([{"filename": "a.pdf", "page": 2, "text": "A"}, {"filename": "b", "page": None, "text": "B"}],)]
    frame = spark.createDataFrame(rows, "b array<struct<filename:string,page:int,text:string>>")
    got = frame.select(T.format_context(F.col("b"))).first()[0]
    assert got == "[1] (a.pdf, page 2)\nA\n\n[2] (b)\nB"
