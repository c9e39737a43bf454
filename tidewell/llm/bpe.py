"""Byte-level BPE encoding and decoding with a published vocabulary.

Every match of the vocabulary's pre-tokenising pattern is encoded separately. Its
bytes, mapped to Latin-1, pass once through an Aho-Corasick automaton of all
tokens. From the longest match at each place the encoder steps forward; where a token
cannot stand beside the one before it, it takes the next shorter match, and where
none is left it backtracks and marks the place as a dead end. A sequence in which every
adjacent pair is what the merges make of that pair's bytes is the merges' own result;
whether a pair is so is worked out once and memoised. As no place is entered again once
it is a dead end, the work grows linearly with the text.

Defined cases: a null text is empty and has no tokens (both digests are those of
nothing); special tokens' strings are ordinary text; an empty table gives an empty
result; repeated rows are encoded alike; other columns are kept out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pandas as pd
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of the memos; what a full memo forgets costs time but no results.
PIECES, PAIRS = 150_000, 500_000
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def _classes(top: int) -> dict[str, str]:
    """Unicode's letters, numbers and white space below ``top`` as the inside of a character class."""

    def ranges(belongs) -> str:
        codes = [c for c in range(top) if belongs(unicodedata.category(chr(c)), c)]
        starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
        ends = [c for c, after in zip(codes, [*codes[1:], -2]) if c + 1 != after]
        return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends))

    return {
        r"\p{L}": ranges(lambda kind, _: kind[0] == "L"),
        r"\p{N}": ranges(lambda kind, _: kind[0] == "N"),
        r"\s": ranges(lambda kind, c: kind[0] == "Z" or 9 <= c <= 13 or c == 0x85),
    }


def spelled_out(pattern: str, top: int = 0x110000) -> str:
    """``pattern`` for ``re``, which has no ``\\p`` and four more characters in ``\\s``, for texts below ``top``."""
    inside = False
    out = []
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern):
        if part in "[]":
            inside = part == "["
        known = _classes(top).get(part.replace("S", "s"))
        if known is None:
            out.append(part)
        else:
            out.append(known if inside else f"[{'^' * (part == chr(92) + 'S')}{known}]")
    return "".join(out)


class Codec:
    """Encoder and decoder for the contents of one rank file."""

    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN):
        rows = (line.split() for line in ranks.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.narrow, self.wide = (re.compile(spelled_out(pattern, top)).findall for top in (0x100, 0x110000))
        self.spines: dict[int, tuple[list[int], list[int]]] = {}
        self.within: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)  # the same pattern with shorter classes, which match faster

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """What the merges make of ``data``, down to ``stop`` parts: for tokens, which are short."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.ranks) * 2))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int) -> tuple[list[int], list[int]]:
        """Along the merges that build ``token``: its first parts and its last parts, from bytes up."""
        known = self.spines.get(token)
        if known is None:
            data = self.tokens[token]
            cut = 0
            if len(data) > 1:
                parts = self.merged(data, stop=2)
                cut = len(self.tokens[parts[0]]) if len(parts) == 2 else 0
            firsts, lasts = (self.spine(self.ranks[data[:cut]])[0], self.spine(self.ranks[data[cut:]])[1]) if cut else ([], [])
            known = self.spines[token] = [*firsts, token], [*lasts, token]
        return known

    def _stay(self, left: int, right: int) -> bool:
        """Follow the merges at the boundary in order of rank: does one ever cross it?"""
        a, b = self.spine(left)[1], self.spine(right)[0]
        i = j = 0
        never = len(self.ranks) * 2
        while True:
            across = self.ranks.get(self.tokens[a[i]] + self.tokens[b[j]], never)
            grow_a = a[i + 1] if i + 1 < len(a) else never
            grow_b = b[j + 1] if j + 1 < len(b) else never
            if across < grow_a and across <= grow_b and across < never:
                return False
            if grow_a == grow_b == never:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` stays as it is after ``left`` (-1: at the start), from the memo if known."""
        key = (left << 32) + right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.merged(self.tokens[right]) == [right] if left < 0 else self.compatible(-1, right) and self._stay(left, right)
            self.fits[key] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest: list[tuple[int, int]] = [(0, 0)] * n
        for end, match in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - match[0]] = match  # ends rise, so the longest comes last
        dead = bytearray(n + 1)
        fits, compatible, shorter = self.fits, self.compatible, self.shorter
        ids: list[int] = []
        sizes: list[int] = []
        place, left, match = 0, -1, longest[0]
        while place < n:
            while match is not None:
                size, rank = match
                if not dead[place + size]:
                    fit = fits.get((left << 32) + rank)
                    if compatible(left, rank) if fit is None else fit:
                        break
                match = shorter(rank)
            if match is None:
                dead[place] = 1
                place -= sizes.pop()
                match = shorter(ids.pop())
                left = ids[-1] if ids else -1
            else:
                ids.append(rank)
                sizes.append(size)
                place += size
                left = rank
                match = longest[place] if place < n else None
        return ids

    def shorter(self, token: int) -> tuple[int, int] | None:
        """The longest token that ``token`` begins with, with its size."""
        if token not in self.within:
            data = self.tokens[token]
            self.within[token] = next(((k, self.ranks[data[:k]]) for k in range(len(data) - 1, 0, -1) if data[:k] in self.ranks), None)
        return self.within[token]

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)

    def _piece(self, piece: str) -> tuple[bytes, bytes]:
        """What a new piece becomes; kept, unless it is long, until twice PIECES others were met."""
        made = self.older.get(piece)
        if made is None:
            ids = self.encode_piece(piece.encode())
            made = ",".join(map(str, ids)).encode(), self.decode(ids)
        if len(piece) <= 64:
            if len(self.pieces) >= PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = made
        return made

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Token count, digest of the decimal ids, digest of the decoded bytes."""
        get, make = self.pieces.get, self._piece
        made = [get(p) or make(p) for p in self.split(text or "")]
        ids = b",".join([m[0] for m in made])
        decoded = b"".join([m[1] for m in made])
        return ids.count(b",") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=2)
def codec_of(ranks: bytes) -> Codec:
    return Codec(ranks)


def codec(path: str) -> Codec:
    return codec_of(Path(path).read_bytes())


def _sent(docs: DataFrame, path: str) -> Broadcast:
    """The rank file for the executors, which need not have it: a megabyte, whatever the rows."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>`` and the digests of each text's ids and of the bytes they decode to."""

    ranks = _sent(docs, path)

    @F.pandas_udf(RESULT)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec_of(ranks.value)
        for batch in texts:
            yield pd.DataFrame([own.digests(t) for t in batch], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), run(F.col(text_col)).alias("made")).select(id_col, "made.*")


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>`` and ``ids``, the token ids of each text."""

    ranks = _sent(docs, path)

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec_of(ranks.value)
        for batch in texts:
            yield pd.Series([own.encode(t or "") for t in batch], dtype=object)

    return docs.select(F.col(id_col), run(F.col(text_col)).alias("ids"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
