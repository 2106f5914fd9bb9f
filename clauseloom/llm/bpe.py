"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its encoding: the token that is an encoding
of itself and whose pair with the last token of the prefix before it would not have been merged otherwise. Storing
that token per prefix makes appending exact (earlier entries never change) and lets an edit be encoded again from
the place of the edit until the entries agree with the old ones for as many bytes as the longest token has.

Texts are cut at white space first, as the pattern does, and every distinct unit of a task is encoded once. Texts go
through in blocks, so memory does not grow with a text's length beyond its ids.

Edge cases: a null text is empty and has no tokens; every byte is a token, so any text can be encoded; special
tokens in a text are ordinary text; repeated rows are encoded like any other; extra columns stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from clauseloom.llm.common import with_made

#: Characters of the Unicode property White_Space (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"

#: The pattern's treatment of white space alone: a run of other characters takes the one space before it.
UNIT = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Where a text may be cut without changing its units.
CUT = f"(?<=[^{SPACE}]) (?=[^{SPACE}])"

#: Characters of a text that are encoded at once.
BLOCK = 1 << 20

#: Distinct units and token pairs that a task remembers before it starts over.
REMEMBERED = 300_000


def read_ranks(path: str) -> bytes:
    """The vocabulary file as it is, to be sent along with the tasks: under 1 MB for 50,000 tokens."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Tokens by id and ids by bytes, with the rule which tokens may stand next to each other."""

    def __init__(self, ranks: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.sizes = [0] * (max(self.tokens) + 1)
        for token, data in self.tokens.items():
            self.sizes[token] = len(data)
        self.pairs: dict[tuple[int, int], bool] = {}
        self._splits: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals, until ``least`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            ranked = [(self.ids.get(a + b, len(self.ids)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == len(self.ids):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token's bytes one; none for a byte, or if merging ends elsewhere."""
        if token not in self._splits:
            data = self.tokens[token]
            parts = self.merged(data, 2) if len(data) > 1 else []
            made = len(parts) == 2 and self.ids[self.tokens[parts[0]] + self.tokens[parts[1]]] == token
            self._splits[token] = (parts[0], parts[1]) if made else None
        return self._splits[token]

    def alone(self, token: int) -> bool:
        """Whether the token's bytes are merged to the token itself."""
        return len(self.tokens[token]) == 1 or self.split(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left``: merging both together gives just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self.alone(left) and self.alone(right) and self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Go back through the merges on both sides, latest first, and look for one across the border that came earlier.

        The two parts at the border stand there until merge ``limit``; equal ranks are merged from the left.
        """
        tokens, ids, limit = self.tokens, self.ids, len(self.ids)
        while True:
            across = ids.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            # Of the two parts the one that was made last is taken apart; a byte was there from the start.
            back_left = left if len(tokens[left]) > 1 else -1
            back_right = right if len(tokens[right]) > 1 else -1
            if back_left < 0 and back_right < 0:
                return True
            if back_left > back_right:
                # A pair across the border stands further right, so it must come strictly earlier.
                limit, left = back_left, self.split(left)[1]
            else:
                # A pair across the border stands further left, so an equal rank already comes earlier.
                limit, right = back_right + 1, self.split(right)[0]


class Prefixes:
    """The last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Earlier entries stay as they are: what ends a prefix does not depend on what follows it."""
        data = self.data = self.data + more
        vocabulary, last = self.vocabulary, self.last
        ids, pairs, fits, longest, sizes = vocabulary.ids, vocabulary.pairs, vocabulary.fits, vocabulary.longest, vocabulary.sizes
        for end in range(len(last), len(data) + 1):
            if end > 1:
                # Only one token is right; most often it is the one before, grown by a byte.
                start = end - 1 - sizes[last[-1]]
                token = ids.get(data[start:end])
                if token is not None:
                    known = pairs.get((last[start], token)) if start else vocabulary.alone(token)
                    if fits(last[start], token) if known is None else known:
                        last.append(token)
                        continue
            start = end - 1
            while True:
                token = ids.get(data[start:end])
                if token is not None:
                    if not start:
                        if vocabulary.alone(token):
                            break
                    else:
                        before = last[start]
                        known = pairs.get((before, token))
                        if fits(before, token) if known is None else known:
                            break
                if not start or end - start == longest:
                    raise ValueError("a byte is missing from the vocabulary")
                start -= 1
            last.append(token)

    def become(self, data: bytes) -> list[int]:
        """Go over to another piece, keeping the entries of the prefix that both share; returns its ids."""
        shared = 0
        for old, new in zip(self.data, data):
            if old != new:
                break
            shared += 1
        self.data = data[:shared]
        del self.last[shared + 1 :]
        self.append(data[shared:])
        return self.ids()

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start`` to ``end``; returns how many prefixes were encoded again."""
        old, shift, changed = self.last, start + len(new) - end, self.data[:start] + new + self.data[end:]
        self.data, self.last, same = changed[:start], old[: start + 1], 0
        for at in range(start, len(changed)):
            self.append(changed[at : at + 1])
            # What follows depends on the bytes and on as many entries as the longest token has bytes.
            inside = at >= start + len(new)
            same = same + 1 if inside and self.last[at + 1] == old[at + 1 - shift] else 0
            if same >= self.vocabulary.longest:
                self.data, self.last = changed, self.last + old[at + 2 - shift :]
                return at + 1 - start
        return len(changed) - start

    def ids(self) -> list[int]:
        out, end, last, sizes = [], len(self.data), self.last, self.vocabulary.sizes
        while end:
            token = last[end]
            out.append(token)
            end -= sizes[token]
        return out[::-1]


class Encoder(dict):
    """Ids of the units seen lately."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        super().__init__()
        self.vocabulary, self.pieces = Vocabulary(ranks), regex.compile(pattern).findall
        self.units, self.cut, self.older = re.compile(UNIT).findall, re.compile(CUT), {}

    @staticmethod
    def of_process(ranks: bytes, pattern: str) -> Encoder:
        """The encoder that earlier tasks of this process have filled. Functions travel by value, so it hangs on sys."""
        kept = sys.__dict__.setdefault("_clauseloom_encoders", {})
        name = hashlib.sha256(ranks + pattern.encode()).digest()
        if name not in kept:
            kept.clear()
            kept[name] = Encoder(ranks, pattern)
        return kept[name]

    def __missing__(self, unit: str) -> tuple[int, ...]:
        self.learn([unit])
        return self[unit]

    def learn(self, units: Iterable[str]) -> None:
        """Encode the units that are new, piece after piece in byte order to share prefixes."""
        new = [unit for unit in units if unit not in self]
        if len(self) + len(new) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        older, pieces = self.older, {}
        for unit in new:
            if unit in older:
                self[unit] = older[unit]
            else:
                # Letters with a blank before them or none are one piece.
                pieces[unit] = [unit] if unit.isascii() and unit.removeprefix(" ").isalpha() else self.pieces(unit)
        ids, known, entries = self.vocabulary.ids, {}, Prefixes(self.vocabulary)
        for data, piece in sorted([(p.encode(), p) for p in {p for parts in pieces.values() for p in parts}]):
            # A piece that is a token is that token, whatever merging would make of it.
            whole = ids.get(data)
            # Tuples of numbers are no work for the garbage collector.
            known[piece] = tuple(entries.become(data)) if whole is None else (whole,)
        for unit, parts in pieces.items():
            self[unit] = known[parts[0]] if len(parts) == 1 else tuple(i for p in parts for i in known[p])

    def blocks(self, text: str) -> Iterator[str]:
        start = 0
        while start < len(text):
            cut = self.cut.search(text, start + BLOCK) if len(text) - start > BLOCK else None
            end = cut.start() if cut else len(text)
            yield text[start:end]
            start = end

    def learned(self, text: str) -> Iterator[list[str]]:
        """The units of a text, block after block, learned."""
        for block in self.blocks(text):
            units = self.units(block)
            self.learn(set(units))
            yield units

    def units_all(self, texts: list[str]) -> Iterator[Iterator[list[str]]]:
        """``learned`` of every text; what is new in all texts of one block is learned at once."""
        short = [self.units(t) if len(t) <= BLOCK else None for t in texts]
        self.learn(set().union(*(units for units in short if units)))
        for text, units in zip(texts, short):
            yield self.learned(text) if units is None else iter([units])

    def ids_of(self, units: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, units)))

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, block after block."""
        return map(self.ids_of, self.learned(text))

    def encode_all(self, texts: list[str]) -> Iterator[Iterator[list[int]]]:
        """``encode`` of every text."""
        return (map(self.ids_of, blocks) for blocks in self.units_all(texts))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def encode(df: DataFrame, text: str, ranks: bytes, pattern: str) -> DataFrame:
    """``df`` without the text, with n_tokens, ``ids`` (the token ids of the whole text) and decoded_sha256 of their bytes."""

    def made() -> Callable:
        encoder = Encoder.of_process(ranks, pattern)

        def make(texts: list[str | None]) -> dict:
            ids = [list(chain.from_iterable(blocks)) for blocks in encoder.encode_all([t or "" for t in texts])]
            decoded = [hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]
            return {
                "n_tokens": pa.array(map(len, ids), pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32())),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }

        return make

    return with_made(df, [text], made, "n_tokens long, ids array<int>, decoded_sha256 string", [text])


def decode(df: DataFrame, ids: str, ranks: bytes, pattern: str) -> DataFrame:
    """``df`` without the ids, with ``decoded``, the bytes that they stand for; null ids are none."""

    def made() -> Callable:
        encoder = Encoder.of_process(ranks, pattern)
        return lambda rows: {"decoded": pa.array([encoder.decode(r or []) for r in rows], pa.binary())}

    return with_made(df, [ids], made, "decoded binary", [ids])


class Told(dict):
    """Of the units seen lately: how many ids they have, these in decimals, and the bytes that the ids decode to."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, unit: str) -> tuple[int, str, bytes]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encoder[unit]
        self[unit] = told = (len(ids), " ".join(map(str, ids)), self.encoder.decode(ids))
        return told


def digests(df: DataFrame, text: str, ranks: bytes, pattern: str) -> DataFrame:
    """``df`` without the text, with n_tokens, ids_sha256 of the decimal ids joined by spaces, decoded_sha256.

    The ids of a text are digested and decoded block by block and never leave the task; decimals and bytes are kept per unit.
    """

    def digest(told: Told, blocks: Iterator[list[str]]) -> tuple[int, str, str]:
        n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
        for units in blocks:
            if units:
                counts, decimals, data = zip(*map(told.__getitem__, units))
                ids_hash.update(((" " if n else "") + " ".join(decimals)).encode())
                bytes_hash.update(b"".join(data))
                n += sum(counts)
        return n, ids_hash.hexdigest(), bytes_hash.hexdigest()

    def made() -> Callable:
        encoder = Encoder.of_process(ranks, pattern)
        told = Told(encoder)

        def make(texts: list[str | None]) -> dict:
            out = [digest(told, blocks) for blocks in encoder.units_all([t or "" for t in texts])]
            n, ids, decoded = zip(*out) if out else ((), (), ())
            return {
                "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()),
            }

        return make

    return with_made(df, [text], made, "n_tokens long, ids_sha256 string, decoded_sha256 string", [text])
