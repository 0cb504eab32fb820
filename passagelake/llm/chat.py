"""Conversations as token ids with a loss mask.

The template of a turn is ``### Role: text</turn>`` and a line break; its three marks are
reserved ids outside the vocabulary. Role and text are encoded apart from the marks and
spliced between them, so no text can produce a mark's id. In the text form, a backslash is
put before every backslash and before every place in a role or text where a mark would
begin, which reading takes away again.

A turn's segments have known lengths, so everything else is a prefix sum: where a segment
begins in its turn, where a turn begins in its conversation, and the loss mask as the sum of
+1 at each start and -1 at each end of what is to be learned.

The result has one row a turn, numbered within its conversation: a conversation of any
length is a run of bounded rows.

Cases: a null text or role is empty; null turns come first and null conversations form one of
their own; rows of the same turn are ordered by role, then text, and each is a turn. An
empty table has no rows. Very long texts are one row each.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, save, worker_cache
from .records import slices_of
from .tokens import encoder, space_led

#: the marks of the template: before the role, between role and text, behind the text
OPEN, BODY, CLOSE = "### ", ": ", "</turn>\n"
#: their ids are the first ones behind the vocabulary
RESERVED = 3
_ESCAPE = re.compile(r"\\|(?=###|</turn>)")
_ESCAPE_ROLE = re.compile(r"\\|(?=###|</turn>|: |:$)")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, pattern: re.Pattern = _ESCAPE) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    cache = worker_cache("tokens")
    if ("tokenizer", path) not in cache:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        cache["tokenizer", path] = tokenizer
    return cache["tokenizer", path]


def assemble(role: np.ndarray, text: np.ndarray, base: int, learned: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a turn, and its loss mask."""
    parts = [np.array([base]), role, np.array([base + 1]), text, np.array([base + 2])]
    ends = np.cumsum([len(x) for x in parts])
    edges = np.zeros(ends[-1] + 1, np.int32)
    if learned:
        edges[ends[2]] += 1
        edges[ends[3]] -= 1
    return np.concatenate(parts).astype("<u4"), np.cumsum(edges[:-1]).astype(np.uint8)


TURNS = "conv_id long, turn long, role string, text string, formatted string, n_ids long, ids binary, mask binary"


def format_turns(conversations: DataFrame, vocabulary: str, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a turn: ``conv_id, n`` (its place), ``start`` (ids before it in the
    conversation), ``formatted`` text, ``ids`` (4-byte integers) and ``mask`` (a byte an id)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )

    def encode(batches):
        import pyarrow as pa

        tokenizer = _tokenizer(vocabulary)
        base = tokenizer.get_vocab_size(with_added_tokens=True)

        look_up = encoder(vocabulary, space_led).encode

        def ids_of(texts):
            flat, bounds = look_up(texts)
            return [flat[bounds[k] : bounds[k + 1]] for k in range(len(texts))]

        schema = pa.schema([
            ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
            ("formatted", pa.string()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary()),
        ])
        for batch in batches:
            for start, stop in slices_of(batch.column(3)):
                head = batch.slice(start, stop - start)
                roles, texts = (head.column(i).to_pylist() for i in (2, 3))
                safe_roles = [escape(x, _ESCAPE_ROLE) for x in roles]
                safe = [escape(x) for x in texts]
                turns = [
                    assemble(a, b, base, role in learn)
                    for a, b, role in zip(ids_of(safe_roles), ids_of(safe), roles)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(head.column(i) for i in range(4)),
                        pa.array([f"{OPEN}{a}{BODY}{b}{CLOSE}" for a, b in zip(safe_roles, safe)]),
                        pa.array([len(i) for i, _ in turns], pa.int64()),
                        pa.array([i.tobytes() for i, _ in turns], pa.binary()),
                        pa.array([m.tobytes() for _, m in turns], pa.binary()),
                    ],
                    schema=schema,
                )

    turns = rows.mapInArrow(encode, TURNS)
    run = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    return turns.select(
        "conv_id", F.row_number().over(run).alias("n"),
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "formatted", "n_ids", "ids", "mask",
    )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_turn(ids: np.ndarray, mask: np.ndarray, tokenizer, base: int) -> tuple[str, str, str]:
    """Role, text and the text under the loss mask, read back from a turn's ids."""
    body = int(np.flatnonzero(ids == base + 1)[0])
    if ids[0] != base or ids[-1] != base + 2:
        raise ValueError("not a turn")

    def decoded(part):
        return unescape(tokenizer.decode(part.tolist(), skip_special_tokens=False)) if len(part) else ""

    return decoded(ids[1:body]), decoded(ids[body + 1 : -1]), decoded(ids[(mask != 0) & (ids < base)])


def read_digests(turns: DataFrame, vocabulary: str) -> DataFrame:
    """What the turns hold, one row a conversation, from a stream of them in order."""
    ordered = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "n")

    def read(batches):
        import pyarrow as pa

        tokenizer = _tokenizer(vocabulary)
        base = tokenizer.get_vocab_size(with_added_tokens=True)
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state = None
        done: list[tuple] = []

        def close():
            own, n, whole, loss_chars, loss, chars = state
            done.append((own, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def out():
            columns = list(zip(*done)) or [[] for _ in names]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            own_ids, formatted, ids, masks = (batch.column(i) for i in range(4))
            for k in range(batch.num_rows):
                own = own_ids[k].as_py()
                if state is None or state[0] != own:
                    if state is not None:
                        close()
                    state = [own, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learned = read_turn(
                    np.frombuffer(ids[k].as_buffer(), "<u4"), np.frombuffer(masks[k].as_buffer(), np.uint8), tokenizer, base
                )
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(formatted[k].as_py())
            yield out()
        if state is not None:
            close()
            yield out()

    return ordered.select("conv_id", "formatted", "ids", "mask").mapInArrow(read, DIGESTS)


def written_turns(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """The formatted turns as a table."""
    return save(format_turns(conversations, vocabulary), "turns")
