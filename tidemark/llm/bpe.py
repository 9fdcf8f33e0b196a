"""Byte-level BPE by backtracking over longest matches.

A piece of text is matched once against an Aho-Corasick automaton of all tokens (bytes as Latin-1
characters). From the longest token at each place the encoder goes forward as long as neighbours
are compatible: two tokens may stand side by side if re-encoding their bytes would not merge across
the seam. If they are not, it tries the next shorter prefix token, and once those run out it steps
back and marks the place as unreachable. Every place is marked once at most, so the time is linear
in the piece, whatever it holds, and the result is exactly that of the merges by rank.
"""

import base64
import hashlib
import re
from collections.abc import Callable
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import map_rows

#: Unicode's White_Space, as the tokenizers' own pattern engine has it; Python's \s takes in U+001C to U+001F too.
SPACE = "\t-\r \x85\xa0  -     　"

#: Words with the one space before them, and runs of space: whole matches of the tokenizers' pattern never cross these cuts.
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")


class Memo(dict):
    """A dict that computes what it lacks and starts anew when full, so memory stays bounded."""

    def __init__(self, function: Callable, limit: int):
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self.function(key)
        if len(key) <= 64:
            self[key] = value
        return value


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def with_space_class(pattern: str) -> str:
    """The splitting pattern with its white space spelled out."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


class Encoder:
    """Encodes and decodes by the ranks of a vocabulary. Needs a rank for every single byte that occurs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 500_000):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.pieces = regex.compile(with_space_class(pattern)).findall
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pair_limit = memo
        self.lengths = [len(t) for t in self.tokens]
        self.word = Memo(self.piece, memo // 2)
        self.chunk = Memo(self.split, memo // 2)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.chunk.__getitem__, CHUNKS.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def split(self, chunk: str) -> tuple[int, ...]:
        pieces = self.pieces(chunk)
        return self.word[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable(map(self.word.__getitem__, pieces)))

    def piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode()
        if (whole := self.ranks.get(text)) is not None:
            return (whole,)
        lengths, pairs, n = self.lengths, self.pairs, len(text)
        longest = [-1] * n
        for end, (back, rank) in self.automaton.iter(text.decode("latin-1")):
            longest[end - back] = rank  # ends rise, so the longest comes last
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if dead[end]:
                fits = False
            elif out:
                fits = pairs.get((out[-1], token))
                if fits is None:
                    fits = self.compatible(out[-1], token)
            else:
                fits = self.reachable(token)
            if fits:
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, longest[end]
            elif (less := self.prefix(token)) is not None:
                token = less
            else:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]

    def prefix(self, token: int) -> int | None:
        """The longest token that this one begins with, besides itself."""
        if token not in self.shorter:
            text = self.tokens[token]
            self.shorter[token] = next((self.ranks[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.ranks), None)
        return self.shorter[token]

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a single byte; None if merges never make it."""
        if token not in self.halves:
            text = self.tokens[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 1:
                best, i = min(((self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1)))
                if best >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (token, token) if len(parts) == 1 and len(text) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        return self.half(token) is not None

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge would cross the seam between two tokens; remembered for each pair."""
        if len(self.pairs) >= self.pair_limit:
            self.pairs.clear()
        known = self.pairs[left, right] = self.reachable(right) and self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the later merge of the two sides again and again: no pair met on the way may merge before it."""
        ranks, tokens, lengths, before = self.ranks, self.tokens, self.lengths, len(self.tokens)
        while True:
            if ranks.get(tokens[left] + tokens[right], before) < before:
                return False
            if lengths[right] > 1 and (right >= left or lengths[left] == 1):
                before, right = right + 1, self.half(right)[0]
            elif lengths[left] > 1:
                before, left = left, self.half(left)[1]
            else:
                return True


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded.clear()
        _loaded[path, pattern] = Encoder(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for every row. Null and empty texts have no ids; repeated and null ids stay rows of their own.

    Other columns are left out. A text is encoded whole, however long.
    """

    def rows(enc, ids, texts):
        return [(i, len(t), t) for i, x in zip(ids, texts, strict=True) for t in [enc.encode(x or "")]]

    return map_rows(docs.select(id_col, text_col), f"{id_col} {_type(docs, id_col)}, n_tokens long, ids array<int>", rows, lambda: encoder(path, pattern))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes) of encode()'s rows. Null ids decode to no bytes."""
    return map_rows(encoded.select(id_col, "ids"), f"{id_col} {_type(encoded, id_col)}, bytes binary", lambda enc, ids, lists: [(i, enc.decode(t or [])) for i, t in zip(ids, lists, strict=True)], lambda: encoder(path, pattern))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """encode() and decode() of every row in one pass, as digests: (id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the bytes that the ids decode to.
    """
    extra = ", ids array<int>" if with_ids else ""

    def setup():
        enc = encoder(path, pattern)
        return enc, [str(i) for i in range(len(enc.tokens))]

    def rows(state, ids, texts):
        (enc, names), out = state, []
        for i, x in zip(ids, texts, strict=True):
            t = enc.encode(x or "")
            row = (i, len(t), hashlib.sha256(",".join(map(names.__getitem__, t)).encode()).hexdigest(), hashlib.sha256(enc.decode(t)).hexdigest())
            out.append((*row, t) if with_ids else row)
        return out

    return map_rows(docs.select(id_col, text_col), f"{id_col} {_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}", rows, setup)


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()
