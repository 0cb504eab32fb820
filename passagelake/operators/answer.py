"""Extractive answers, and conversation history handed to a generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as T
from ..functions.text import bind

ANSWER = "struct<text:string,cited:array<int>>"


def quotes(query_terms: Column, blocks: Column) -> Column:
    """Scored sentences of the first blocks that share enough words with the question."""
    needed = F.when(F.size(query_terms) >= 3, 2).otherwise(1)

    def scored(block):
        def score(sentence, position):
            def measured(terms):
                overlap = F.size(F.array_intersect(query_terms, terms))
                density = overlap / (F.lit(1.0) + F.sqrt(F.size(terms).cast("double")))
                return F.struct(
                    (-(density / F.sqrt(block.n.cast("double")))).alias("negated"),
                    block.n.alias("n"),
                    position.alias("position"),
                    sentence.alias("sentence"),
                    overlap.alias("overlap"),
                    T.word_count(sentence).alias("words"),
                )

            return bind(F.array_distinct(T.tokens(sentence)), measured)

        return F.filter(
            F.transform(T.quote_sentences(block.text), score),
            lambda q: (q.words >= lx.EXTRACTIVE_MIN_WORDS) & (q.overlap >= needed),
        )

    return F.flatten(F.transform(F.slice(blocks, 1, lx.EXTRACTIVE_BLOCKS), scored))


def extractive_answer(question: Column, blocks: Column) -> Column:
    """Quote the best sentences, each followed by the number of its block."""
    terms = F.array_distinct(F.filter(T.tokens(question), lambda t: ~T.is_stopword(t)))

    def compose(picked):
        lines = F.transform(
            picked,
            lambda q: F.concat(
                T.rstrip(q.sentence), F.lit(" ["), q.n.cast("string"), F.lit("]")
            ),
        )
        first = T.rstrip(F.left(F.get(blocks, F.lit(0)).text, F.lit(lx.EXTRACTIVE_FALLBACK_CHARS)))
        return (
            F.when(
                F.size(picked) > 0,
                F.struct(
                    F.array_join(lines, "\n\n").alias("text"),
                    F.array_sort(F.array_distinct(F.transform(picked, lambda q: q.n))).alias("cited"),
                ).cast(ANSWER),
            )
            .when(
                F.size(blocks) > 0,
                F.struct(
                    F.concat(first, F.lit(" [1]")).alias("text"), F.array(F.lit(1)).alias("cited")
                ).cast(ANSWER),
            )
            .otherwise(
                F.struct(
                    F.lit(lx.NO_PASSAGE_ANSWER).alias("text"),
                    F.array().cast("array<int>").alias("cited"),
                ).cast(ANSWER)
            )
        )

    best = bind(
        terms, lambda t: F.slice(F.array_sort(quotes(t, blocks)), 1, lx.EXTRACTIVE_PICKS)
    )
    return bind(best, compose)


def recent_turns(history: Column) -> Column:
    """The last turns of ``array<struct<role,content>>``."""
    kept = F.least(F.size(history), F.lit(lx.HISTORY_TURNS))
    return F.slice(history, F.size(history) - kept + 1, kept)


def history_messages(history: Column) -> Column:
    """Recent turns fit to send: known roles, no blanks, beginning with the user."""
    def valid(turn):
        return turn.role.isin("user", "assistant") & (T.strip(turn.content) != "")

    trimmed = F.transform(
        F.filter(recent_turns(history), valid),
        lambda t: F.struct(t.role.alias("role"), T.strip(t.content).alias("content")),
    )

    def from_first_user(turns):
        at = F.array_position(F.transform(turns, lambda t: t.role), F.lit("user")).cast("int")
        return F.when(at == 0, F.slice(turns, 1, 0)).otherwise(
            F.slice(turns, F.greatest(at, F.lit(1)), F.size(turns))
        )

    return bind(trimmed, from_first_user)


def prompt_messages(question: Column, blocks: Column, history: Column) -> Column:
    """History followed by the excerpts and the question, as a generator receives them."""
    last = F.struct(
        F.lit("user").alias("role"),
        F.concat(
            F.lit("Excerpts:\n\n"), T.format_context(blocks), F.lit("\n\nQuestion: "), question
        ).alias("content"),
    )
    return F.concat(history_messages(history), F.array(last))
