"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the bytes of all tokens finds every token that occurs in a
run of letters, digits or signs. Two neighbouring tokens are *compatible* if the merges
leave them as they are when they stand side by side; a sequence of compatible neighbours
over all bytes is the one that the merges give. So the encoder takes the longest match that is
compatible with the token before it, a shorter one where none is, and takes the last token
back where none of those is either. A place that was found a dead end is not tried again, which
makes the work linear in the text. Compatibility is looked up in a table that is filled as pairs are
met: undoing the merges along the edge of both tokens shows whether some merge across the edge would
have come first.

Decoding lays the tokens' bytes end to end and copies the range of every id.

Cases: a null or empty text has no ids, and no ids are the empty text. Every row is a document,
also if its id is null or repeated; the id column keeps its type and name, other columns
are left out. Texts of any length are encoded whole: matches are held for a block of
``BLOCK`` bytes at a time. With ``special`` the strings of special tokens in a text become
their ids, as the tokenizers library does unless told otherwise. An empty table gives none.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker_cache
from .flat import gather, strings
from .records import slices_of
from .tokens import PieceEncoder, space_led

#: fixed value: how byte-level BPE cuts a text before it merges
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: bytes of a run whose matches are held at a time, and how many such blocks
BLOCK, BLOCKS = 4096, 4
#: pairs and words that are remembered before the table starts anew
KEPT_PAIRS, KEPT_WORDS = 250_000, 50_000


def byte_letters() -> dict[str, int]:
    """Letters that vocabulary files write for bytes: printable Latin-1 for itself, the rest
    from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            content = json.load(source)
        letters = byte_letters()
        ids = content["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in content["added_tokens"]}
        top = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * top
        for token, k in ids.items():
            self.bytes[k] = bytes(letters[c] for c in token)
        for token, k in self.special.items():
            self.bytes[k] = token.encode()
        #: rank of the merge of two tokens; the two parts of a token, and the rank that made it
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, pair in enumerate(content["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = ids[left + right]
            self.rank[ids[left], ids[right]] = rank
            if whole not in self.parts:
                self.parts[whole] = ids[left], ids[right]
                self.made[whole] = rank
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes], dtype=np.int64)))


class Encoder:
    """The backtracking encoder of one vocabulary."""

    def __init__(self, path: str, special: bool = True):
        import ahocorasick
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(PATTERN)
        self.library = ByteLevel(add_prefix_space=False)
        names = sorted(self.vocabulary.special, key=len, reverse=True) if special else []
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self._edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._compatible: dict[int, bool] = {}
        self._seen: dict[bytes, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        self.longest = 1
        for k, token in enumerate(self.vocabulary.bytes):
            if token and (len(token) == 1 or self._reached(k)):
                self.automaton.add_word(token.decode("latin-1"), (k, len(token)))
                self.longest = max(self.longest, len(token))
        self.automaton.make_automaton()

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Parts at one edge (0: left, 1: right) of a token, and the rank of the merge that ends each."""
        found = self._edges.get((token, side))
        if found is None:
            found, until, part = [], float("inf"), token
            while True:
                found.append((part, until))
                if part not in self.vocabulary.parts:
                    break
                part, until = self.vocabulary.parts[part][side], self.vocabulary.made[part]
            self._edges[token, side] = found
        return found

    def _first_across(self, left: int, right: int) -> float:
        """Rank of the first merge over the edge between two tokens (infinite: none)."""
        ranks = self.vocabulary.rank
        first = float("inf")
        for a, a_until in self._edge(left, 1):
            for b, b_until in self._edge(right, 0):
                rank = ranks.get((a, b))
                # of equal merges the left one comes first
                if rank is not None and rank < first and rank < a_until and rank <= b_until:
                    first = rank
        return first

    def _reached(self, token: int) -> bool:
        """Whether the merges make this token of its own bytes."""
        if token not in self.vocabulary.parts:
            return False
        return self._first_across(*self.vocabulary.parts[token]) == self.vocabulary.made[token]

    def compatible(self, left: int, right: int) -> bool:
        key = (left << 32) | right
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= KEPT_PAIRS:
                self._compatible.clear()
            known = self._compatible[key] = self._first_across(left, right) == float("inf")
        return known

    def _matches(self, text: str):
        """A function from a place to the tokens that begin there, the longest last."""
        n = len(text)
        if n <= BLOCK:
            return self._block(text, 0, n).__getitem__
        blocks: dict[int, list[list[tuple[int, int]]]] = {}

        def at(place: int) -> list[tuple[int, int]]:
            k = place // BLOCK
            if k not in blocks:
                while len(blocks) >= BLOCKS:
                    del blocks[next(iter(blocks))]
                blocks[k] = self._block(text, k * BLOCK, min(n, (k + 1) * BLOCK))
            return blocks[k][place - k * BLOCK]

        return at

    def _block(self, text: str, low: int, high: int) -> list[list[tuple[int, int]]]:
        found: list[list[tuple[int, int]]] = [[] for _ in range(high - low)]
        for end, match in self.automaton.iter(text, low, min(len(text), high + self.longest)):
            start = end + 1 - match[1]
            if start < high:
                found[start - low].append(match)
        return found

    def _longest(self, text: str) -> list[int] | None:
        """The longest match at every place, where all neighbours are compatible."""
        known = self._compatible
        ids: list[int] = []
        last, size = -1, 0
        for _, (token, n) in self.automaton.iter_long(text):
            size += n
            if last >= 0:
                fits = known.get((last << 32) | token)
                if not (self.compatible(last, token) if fits is None else fits):
                    return None
            ids.append(token)
            last = token
        return ids if size == len(text) else None

    def _backtrack(self, text: str) -> list[int]:
        at, compatible, n = self._matches(text), self.compatible, len(text)
        dead = bytearray(n + 1)
        path: list[tuple[int, int, int]] = []  # token, where it begins, shorter matches left there
        place, here = 0, at(0)
        left = len(here)
        while place < n:
            last = path[-1][0] if path else -1
            while left:
                left -= 1
                token, size = here[left]
                if not dead[place + size] and (last < 0 or compatible(last, token)):
                    path.append((token, place, left))
                    place += size
                    if place < n:
                        here = at(place)
                        left = len(here)
                    break
            else:
                dead[place] = 1
                _, place, left = path.pop()
                here = at(place)
        return [token for token, _, _ in path]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one run that the pattern leaves whole."""
        ids = self._seen.get(word)
        if ids is None:
            text = word.decode("latin-1")
            ids = self._longest(text)
            if ids is None:
                ids = self._backtrack(text)
            if len(word) <= 64:
                if len(self._seen) >= KEPT_WORDS:
                    self._seen.clear()
                self._seen[word] = ids
        return ids

    def cut(self, text: str) -> list[str]:
        """The runs of a text. Beyond Latin letters the library's own tables decide, which know
        fewer characters than those of ``regex``."""
        if text.isascii() or max(text) < "\u0250":
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        parts = self.marks.split(text) if self.marks else [text]
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.vocabulary.special[part])
            elif part:
                for word in self.cut(part):
                    ids += self.encode_word(word.encode())
        return ids

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them."""
        ids = [self.encode(x) for x in pieces]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return lengths, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))


def _pieces(path: str, special: bool) -> PieceEncoder:
    cache = worker_cache("tokens")
    key = ("bpe", path, special)
    if key not in cache:
        cache[key] = PieceEncoder(path, space_led, Encoder(path, special).encode_pieces)
    return cache[key]


def offset_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens, and where each token's begin; the merges are not kept."""
    cache = worker_cache("tokens")
    if ("offsets", path) not in cache:
        vocabulary = Vocabulary(path)
        cache["offsets", path] = vocabulary.data, vocabulary.offsets
    return cache["offsets", path]


def encode(
    docs: DataFrame, vocabulary: str, special: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id column and ``ids``, the token ids of every whole text."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def run(batches):
        import pyarrow as pa

        look_up = _pieces(vocabulary, special).encode
        for batch in batches:
            texts = batch.column(1)
            for start, stop in slices_of(texts):
                ids, bounds = look_up(texts.slice(start, stop - start))
                column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), column], ["_id", "ids"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The frame with ``text``, which its ``ids`` stand for; null ids give the empty text.

    Bytes that are no UTF-8, as ids of any origin may give, become replacement characters.
    """
    schema = f"{encoded.schema.simpleString()[7:-1]},text:string"
    place = encoded.columns.index("ids")

    def run(batches):
        import pyarrow as pa

        table = offset_table(vocabulary)
        for batch in batches:
            lists = batch.column(place)
            for start, stop in _runs(lists):
                some = batch.slice(start, stop - start)
                column = some.column(place)
                counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                which = column.flatten().to_numpy(zero_copy_only=False)
                sizes, data = gather(*table, which)
                ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
                texts = strings(data, ends)
                try:
                    texts.validate(full=True)
                    texts = texts.cast(pa.string())
                except pa.ArrowInvalid:
                    raw = data.tobytes()
                    texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns, texts], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, schema)


def _runs(lists, values: int = 1 << 18):
    """Ranges of a column of lists with about so many values, or one list."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > values:
            yield start, i
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield start, len(lengths)
