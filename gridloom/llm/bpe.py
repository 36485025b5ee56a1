"""Byte-level BPE encoding and decoding in linear time.

A vocabulary is a list of byte strings with ranks; merging always takes the
adjacent pair of lowest rank. Instead of merging, the encoder walks a piece from
left to right. An Aho-Corasick automaton over the reversed tokens (bytes mapped to
Latin-1 characters, as pyahocorasick works on text) gives, in one pass over the reversed piece, the longest token that
starts at each place. The walk takes it if it may stand after the previous
token, else shorter prefixes of it, and steps back when none fits. Two tokens
may stand side by side if merging their joint bytes gives just these two; that
answer depends on the two tokens alone and is memoised. A sequence whose
neighbours are all compatible is the one that merging gives, and places once
left are never tried again, so a piece takes linear time, and memory of a few words a byte.

Nulls: a null text counts as empty and gives no ids; null ids decode to no
bytes. Other columns of the input are kept as they are; a column that has the
name of an output column is replaced. Rows, repeated ones too, are encoded each by itself. An empty table gives an empty table. A piece of
any length is held once, with some 40 bytes a byte.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import numbered, ready

#: Pieces whose ids a worker remembers; beyond it the memory starts anew. No result depends on it.
REMEMBERED = 1 << 19

# Letters, digits and white space of Latin-1, for texts that hold nothing else.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"


def latin_pattern(pattern: str) -> str:
    """``pattern`` for the standard library's ``re``, valid on Latin-1 texts, where it is about three times as fast."""
    for old, new in (
        (r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]"), (r"\p{L}", f"[{_L}]"), (r"\p{N}", f"[{_N}]"), (r"\s", f"[{_S}]"), (r"\S", f"[^{_S}]"),
    ):
        pattern = pattern.replace(old, new)
    return pattern


class Tokenizer:
    """A vocabulary in the form of its file's bytes (base64 token, space, rank) and the pattern that cuts texts into pieces."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        size = max(self.rank.values()) + 1
        self.token: list[bytes] = [b""] * size
        for token, r in self.rank.items():
            self.token[r] = token
        self.size = [len(t) for t in self.token]
        self.pieces = regex.compile(pattern)
        self.latin_pieces = re.compile(p) if "\\" not in (p := latin_pattern(pattern)) else None
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self._learn_parts()
        self.shorter: dict[int, int | None] = {}
        self.seen: dict[str, bytes] = _Memory(self)

    def _learn_parts(self) -> None:
        """The last merge that makes each token; a token that no merge makes is left out of the automaton."""
        rank, parts = self.rank, self.parts
        for r, token in enumerate(self.token):
            if len(token) == 1:
                parts[r] = (r, r)
            for k in range(1, len(token)):
                a, b = rank.get(token[:k]), rank.get(token[k:])
                if a is not None and b is not None and a < r and b < r and parts[a] and parts[b] and self._stand(a, b, r):
                    parts[r] = (a, b)
                    break
            if parts[r]:
                self.automaton.add_word(token[::-1].decode("latin-1"), r)
        self.automaton.make_automaton()

    def _stand(self, a: int, b: int, limit: int) -> bool:
        """Whether merging a's and b's bytes, by ranks below ``limit``, leaves the border between them.

        The merges at the border are undone from the last to the first: at each
        step the side merged later is opened, and a pair across the border that
        ranks before that merge would have been merged instead.
        """
        token, rank, parts = self.token, self.rank, self.parts
        while True:
            joint = rank.get(token[a] + token[b])
            if joint is not None and joint < limit:
                return False
            open_a, open_b = len(token[a]) > 1, len(token[b]) > 1
            if open_a and (a > b or not open_b):
                limit, a = a, parts[a][1]
            elif open_b:
                # on equal ranks the left one is merged first, so a pair of b's own rank across the border wins
                limit, b = b + 1, parts[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= 2 * REMEMBERED:
                self.fits.clear()
            known = self.fits[key] = self._stand(a, b, 1 << 60)
        return known

    def prefix(self, r: int) -> int | None:
        """The longest shorter token that starts this one."""
        if r not in self.shorter:
            token = self.token[r]
            found = (x for k in range(len(token) - 1, 0, -1) if (x := self.rank.get(token[:k])) is not None and self.parts[x])
            self.shorter[r] = next(found, None)
        return self.shorter[r]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, size, fits = len(piece), self.size, self.fits
        longest: list[int | None] = [None] * n
        for at, r in self.automaton.iter(piece[::-1].decode("latin-1")):  # of one place the longest comes first
            if longest[n - 1 - at] is None:
                longest[n - 1 - at] = r
        closed: set[int] = set()
        ids: list[int] = []
        at, last = 0, -1
        r: int | None = longest[0]
        while True:
            while r is not None:
                end = at + size[r]
                if end not in closed:
                    if last < 0:
                        break
                    fit = fits.get(last << 32 | r)
                    if fit or (fit is None and self.compatible(last, r)):
                        break
                r = self.prefix(r)
            if r is not None:
                ids.append(r)
                if end == n:
                    return ids
                at, last = end, r
                r = longest[at]
            else:
                closed.add(at)
                r = ids.pop()
                at -= size[r]
                last = ids[-1] if ids else -1

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.latin_pieces and (text.isascii() or max(text) < "Ā"):
            found = self.latin_pieces.findall(text)
        else:
            found = self.pieces.findall(text)
        return b"".join(map(self.seen.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memory(dict):
    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.tokenizer.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


_built: dict[bytes, Tokenizer] = {}


def tokenizer(ranks_file: bytes, pattern: str) -> Tokenizer:
    """Built once for each worker process."""
    key = hashlib.sha256(ranks_file + pattern.encode()).digest()
    if key not in _built:
        _built[key] = Tokenizer(ranks_file, pattern)
    return _built[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (binary: little-endian unsigned 32-bit ids) and ``n_tokens`` (long).

    The vocabulary file is read once on the driver and broadcast; its size is
    that of a vocabulary, under 1 MB, and does not grow with the data.
    """
    spark = ready(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary.value, pattern)
        for batch in batches:
            ids = [coder.encode(t) if t else b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            out = [*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "token_ids", "n_tokens"])

    keep = [c for c in docs.columns if c not in ("token_ids", "n_tokens")]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("\u0001text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(b"").alias("token_ids"), F.lit(0).cast("long").alias("n_tokens")).schema
    return numbered(source).mapInArrow(run, schema)


def decode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``docs`` with ``decoded`` (binary), the bytes that the ids stand for."""
    spark = ready(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = [b""] * 0
        for a, b in map(bytes.split, vocabulary.value.splitlines()):
            r = int(b)
            token.extend([b""] * (r + 1 - len(token)))
            token[r] = base64.b64decode(a)
        for batch in batches:
            out = [b"".join(map(token.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    keep = [c for c in docs.columns if c != "decoded"]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids}`").alias("\u0001ids"))
    return numbered(source).mapInArrow(run, docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(b"").alias("decoded")).schema)


