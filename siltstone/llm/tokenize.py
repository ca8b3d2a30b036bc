"""Byte-level BPE encoding by dynamic programming over prefixes.

Texts are cut into pieces by the vocabulary's pattern. For every prefix of a piece there is
exactly one token that ends its encoding: an automaton over the vocabulary lists the tokens
that are suffixes of the prefix, and the one is kept that is compatible with the last token of
the prefix before it. Following these last tokens back from the end gives the ids. The work is
linear in the piece's length, so a piece of a megabyte without a blank is no special case.

Two tokens are compatible if encoding their joined bytes gives the two back, i.e. if no merge
across the border comes before the merges that form them. Encoded pieces are kept per worker
in a table of bounded size, as pieces repeat.

Defined results: a null and an empty text give an empty list; a blank text is encoded like any
other. Special tokens are never produced; their strings are ordinary text. Lone surrogates
cannot occur in Spark strings. Repeated rows are encoded each. No rows give no rows. Only the
id and text columns are read, so other columns may clash with nothing.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Encoded pieces a worker remembers, and the length in characters up to which a piece is remembered.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 64
#: A vocabulary is sent to every executor; larger files are refused.
MAX_VOCABULARY_BYTES = 64 << 20

_NEVER = 1 << 60


class BytePairEncoder:
    """Exact encoder of one vocabulary: lines of base64 token and rank."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.find = regex.compile(pattern).findall
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        # one character per byte, so that matches are byte matches
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), (r, len(t)))
        self.automaton.make_automaton()
        self.pieces: dict[str, bytes] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge forms ``token``; None for a byte."""
        if token in self._parts:
            return self._parts[token]
        t = self.bytes[token]
        found = None
        if len(t) > 1:
            # merge the token's bytes until two are left
            seq = [t[i : i + 1] for i in range(len(t))]
            while len(seq) > 2:
                best, at = _NEVER, -1
                for i in range(len(seq) - 1):
                    r = self.rank.get(seq[i] + seq[i + 1], _NEVER)
                    if r < best and r < token:
                        best, at = r, i
                if at < 0:
                    break
                seq[at : at + 2] = [seq[at] + seq[at + 1]]
            if len(seq) == 2:
                found = (self.rank[seq[0]], self.rank[seq[1]])
        self._parts[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens encode to just these two.

        Walks back in time through the tokens that touch the border. ``x`` and ``y`` touch it
        from their own merge until they are merged into their successors, at ``x_end`` and
        ``y_end``; a merge of the two within that time would have crossed the border. Of two
        equal merges the left one comes first.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is not None:
            return known
        x, y, x_end, y_end = left, right, _NEVER, _NEVER
        ok = True
        while True:
            m = self.rank.get(self.bytes[x] + self.bytes[y])
            if m is not None and m < x_end and m <= y_end:
                ok = False
                break
            if x > y:
                p = self.parts(x)
                if p is None:
                    # x is a byte: undo y as far as it goes
                    p = self.parts(y)
                    if p is None:
                        break
                    y_end, y = y, p[0]
                else:
                    x_end, x = x, p[1]
            else:
                p = self.parts(y)
                if p is None:
                    p = self.parts(x)
                    if p is None:
                        break
                    x_end, x = x, p[1]
                else:
                    y_end, y = y, p[0]
        self._fits[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        n = len(piece)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        fits = self.fits
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            i = end + 1
            if last[i] >= 0:
                continue
            start = i - length
            if start == 0 or fits(last[start], token):
                last[i], back[i] = token, start
        ids, i = [], n
        while i:
            ids.append(last[i])
            i = back[i]
        ids.reverse()
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = np.array(self.encode_piece(piece.encode("utf-8")), dtype=np.int32).tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            if len(self._fits) > 4 * REMEMBERED:
                self._fits.clear()
            self.pieces[piece] = ids
        return ids

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a text as packed int32."""
        if not text:
            return b""
        known, new = self.pieces.get, self._piece
        return b"".join([known(p) or new(p) for p in self.find(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()


_ENCODERS: dict[tuple[int, str], BytePairEncoder] = {}


def _encoder(vocabulary: bytes, pattern: str) -> BytePairEncoder:
    """One encoder per worker process."""
    key = (hash(vocabulary), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(vocabulary, pattern)
    return _ENCODERS[key]


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every document. Narrow: no shuffle, one pass over the id and text columns."""
    size = os.path.getsize(vocabulary)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of {size} bytes is too large to send to executors")
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())
    src = documents.select(documents[id_col].alias(id_col), documents[text_col].alias(text_col))
    id_type = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or _encoder(sent.value, pattern)
            packed = [enc.encode_packed(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) >> 2 for p in packed], out=offsets[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[id_col, "ids"])

    return spread(src).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")
