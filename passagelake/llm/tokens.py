"""Token ids of whole texts, through a dictionary of the pieces that texts are made of.

Both tokenizers cut a text at white space before they look for tokens, so a text's ids are
the ids of its pieces, one after the other. A batch is cut as one array of bytes; only its
different pieces become Python objects, are looked up in a dictionary that the worker
keeps, and are encoded if they are new.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np

from .common import worker_cache
from .flat import flat, gather, pieces_of, strings

#: pieces in each of the two generations that a worker keeps
KEPT_PIECES = 500_000
#: pieces handed to the tokenizer at a time
ENCODE_AT_ONCE = 2_000

#: white space of one byte, and other control characters that some library takes for it
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(0x1C, 0x21)]] = True
#: first bytes of the longer characters among which there is white space
_ODD = np.zeros(256, bool)
_ODD[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_SPACED = np.zeros(256, bool)
_SPACED[[0x20, 9, 10, 13]] = True


def _sign_behind_letter(data: np.ndarray) -> np.ndarray:
    """Full stops and commas right behind a letter of ASCII, where both tokenizers end a token.
    (Behind the last letter of the text before, there is a bound anyway.)"""
    small = data | 0x20
    sign = (data == 0x2E) | (data == 0x2C)
    sign[1:] &= (small[:-1] >= 0x61) & (small[:-1] <= 0x7A)
    sign[:1] = False
    return sign


def space_led(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut before every single space, around every single line break and before a sign behind a
    word: byte-level BPE joins a space to the word behind it. Nothing is cut beside other or unsure white space.

    Returns bytes, the bounds of the pieces in them, and how many pieces each text has.
    """
    n = len(data)
    # one of these stands for the edges of texts too
    plain = np.zeros(n + 2, bool)  # shifted by one
    odd = _ODD[data]
    part = (data & 0xC0) == 0x80
    inside = odd.copy()  # bytes of characters that may be white space
    inside[1:] |= odd[:-1] & part[1:]
    inside[2:] |= odd[:-2] & part[1:-1] & part[2:]
    plain[1:-1] = ~(_WHITE[data] | inside)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = plain[:-2] & ~edge[:-1]
    after = plain[2:] & ~edge[1:]
    alone = before & after
    cut = edge
    cut[:-1] |= alone & ((data == 0x20) | (data == 0x0A))
    cut[1:] |= alone & (data == 0x0A)
    cut[:-1] |= _sign_behind_letter(data)
    cut[n] = True
    starts = np.flatnonzero(cut)
    return data, starts, np.diff(np.searchsorted(starts, bounds))


def spaced(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut at spaces, tabs and line breaks, for tokenizers that drop white space."""
    n = len(data)
    word = ~_SPACED[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    begins |= _sign_behind_letter(data)
    starts = np.flatnonzero(begins)
    kept = np.cumsum(word)
    places = kept[starts] - 1 if n else starts
    return data[word], np.append(places, kept[-1] if n else 0), np.diff(np.searchsorted(starts, bounds))


def _stem(piece: bytes) -> int:
    """Where the full stop or comma behind a word begins; 0 if there is none.

    Both tokenizers end a token where letters end, so the two parts can be encoded apart.
    """
    n = len(piece) - 1
    if n <= 0 or piece[n] not in b".,":
        return 0
    last = piece[:n].decode()[-1]
    return n if last < "\u0250" and last.isalpha() else 0


class PieceEncoder:
    """Ids of many texts at once, as flat arrays.

    ``encode_pieces`` takes a list of pieces and returns how many ids each has, and all ids;
    without it, the tokenizers library does so with a vocabulary file.
    """

    def __init__(self, path: str, cut, encode_pieces=None):
        self.encode_pieces = encode_pieces or _library(path)
        self.cut = cut
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.offsets = np.zeros(1 << 16, np.int64)
        self.used = 0
        self.older = None

    def _renew(self) -> None:
        """Start a new generation; what the last one held is still looked up."""
        older = (self.known, self.ids, self.offsets)
        self._reset()
        self.older = older

    def _add(self, pieces: list[bytes], lengths: np.ndarray, ids: np.ndarray) -> None:
        n, m = len(self.known), len(pieces)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while n + m >= len(self.offsets):
            self.offsets = np.resize(self.offsets, 2 * len(self.offsets))
        self.ids[self.used : self.used + len(ids)] = ids
        self.offsets[n + 1 : n + m + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, n + m)))

    def _recall(self, pieces: list[bytes]) -> list[bytes]:
        """Take over what the older generation knows; returns the rest."""
        if self.older is None or not pieces:
            return pieces
        known, ids, offsets = self.older
        which = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        has = which >= 0
        lengths, flat = gather(ids, offsets, which[has])
        self._add([x for x, h in zip(pieces, has) if h], lengths, flat)
        return [x for x, h in zip(pieces, has) if not h]

    def _learn(self, pieces: list[bytes]) -> None:
        pieces = self._recall(pieces)
        stems = [(x, at) for x in pieces if (at := _stem(x))]
        split = {x for x, _ in stems}
        parts = dict.fromkeys(y for x, at in stems for y in (x[:at], x[at:]))
        parts.update(dict.fromkeys(x for x in pieces if x not in split))
        new = self._recall([x for x in parts if x not in self.known])
        for at in range(0, len(new), ENCODE_AT_ONCE):
            some = new[at : at + ENCODE_AT_ONCE]
            self._add(some, *self.encode_pieces([x.decode() for x in some]))
        if stems:
            halves = [self.known[y] for x, at in stems for y in (x[:at], x[at:])]
            lengths, flat = gather(self.ids, self.offsets, np.array(halves))
            self._add([x for x, _ in stems], lengths.reshape(-1, 2).sum(axis=1), flat)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (a list or an Arrow column), and the bounds of each text's ids
        (one more than there are texts)."""
        import pyarrow as pa

        if len(self.known) > KEPT_PIECES:
            self._renew()
        data, bounds, counts = self.cut(*flat(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts))
        coded = strings(data, bounds, text=False).dictionary_encode()
        pieces = pieces_of(coded.dictionary)
        which = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(which < 0)
        if len(missing):
            new = [pieces[i] for i in missing]
            self._learn(new)
            which[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        lengths, ids = gather(self.ids, self.offsets, which[coded.indices.to_numpy()])
        upto = np.concatenate(([0], np.cumsum(lengths)))
        return ids, upto[np.concatenate(([0], np.cumsum(counts)))]


def _library(path: str):
    """``encode_pieces`` of the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return lengths, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))

    return encode_pieces


def encoder(path: str, cut) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    cache = worker_cache("tokens")
    key = ("encoder", path, cut.__name__)
    if key not in cache:
        cache[key] = PieceEncoder(path, cut)
    return cache[key]
