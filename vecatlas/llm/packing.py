"""Packing by power-of-two decomposition.

A document of n tokens is cut into blocks of the longest length and then into the binary digits of
the rest, longest first (5000 -> 2048, 2048, 512, 256, 128, 8). Each piece is a sequence of its own:
no sequence crosses documents and none is padded. Sequences of equal length form a bucket, from which
a trainer draws equal-length batches; :func:`write_buckets` lays the buckets out as folders.

Null and empty texts still give the end id, so one piece of length 1. Repeated rows are packed once
each. Other columns of the input are not looked at.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from vecatlas.llm.common import documents, frugal

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"
REMEMBERED = 600_000  # chunks, and pieces of chunks, that a task remembers

# The splitting pattern of the tokenizer file, for lower-case text of Latin letters.
_LATIN = [(chr(c), unicodedata.category(chr(c))[0]) for c in range(0x21, 0x180) if c not in range(0x7F, 0xA1)]
_LETTERS, _NUMBERS, _OTHERS = ("".join(re.escape(c) for c, kind in _LATIN if kind in kinds) for kinds in ("L", "N", "CMPSZ"))
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[{_OTHERS}]+")
_ODD = "[^\u0021-\u007e\u00a1-\u012f\u0131-\u017f]"  # what else the fast way leaves to the tokenizer


def cuts(n: int, longest: int = 2048) -> list[int]:
    """The lengths that a document of n tokens is cut into."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Pieces(dict):
    """Ids of the words and signs that chunks consist of; emptied when full, on which only speed depends."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize, self.as_bytes = tokenizer.model.tokenize, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        shown = piece if piece.isascii() else self.as_bytes(piece)[0][0]
        ids = self[piece] = _packed([t.id for t in self.tokenize(shown)])
        return ids


class Encoder:
    """Ids of a text as packed little-endian 32-bit integers.

    The tokenizer drops white space and never joins what stands on its two sides, so each chunk between
    ASCII blanks is encoded by itself and remembered, for good if it came twice in one group of texts. A chunk of
    Latin letters is lower-cased and cut by the tokenizer's own splitting pattern into words and signs, which recur more often.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.odd = re.compile("|".join([_ODD, *(f"(?i:{re.escape(t.content)})" for t in self.whole.get_added_tokens_decoder().values())]))
        self.chunks: dict[bytes, bytes] = {}
        self.frequent: dict[bytes, bytes] = {}
        self.pieces = Pieces(self.whole)

    def _encode(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.odd.search(text):
            return _packed(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join([self.pieces[p] for p in _SPLIT.findall(text.lower())])

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Texts of about a megabyte come at a time, or a longer single one."""
        if len(self.chunks) > REMEMBERED:
            self.chunks = dict(self.frequent)
        known, cut = self.chunks, [t.split() for t in texts]
        new = Counter([w for c in cut for w in c if w not in known])
        for w, n in new.items():
            ids = known[w] = self._encode(w)
            if n > 1 and len(self.frequent) < REMEMBERED // 2:
                self.frequent[w] = ids
        return [b"".join([known[w] for w in c]) for c in cut]


def _few(sizes: list[int], most: int = 1 << 20):
    """Neighbouring texts of about so many bytes together, as (first, end)."""
    first, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset, bucket); ids are packed, see :func:`unpack_ids`; a bucket holds the pieces of 2^bucket tokens.

    longest is a power of two. The work is one narrow pass: nothing is shuffled, and a task holds one
    Arrow batch at a time. sequence_id is unique and stable for the same input files.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    end = _packed([end_id])

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        encode = Encoder(tokenizer_path)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in _few(pc.binary_length(texts).to_pylist()):
                out: tuple[list, ...] = ([], [], [], [], [])
                for name, ids in zip(names[lo:hi], encode(texts[lo:hi].to_pylist()), strict=True):
                    ids += end
                    n, at = len(ids) // 4, 0
                    for length in cuts(n, longest):
                        for column, value in zip(out, (name, at, length, ids[4 * at : 4 * (at + length)], n), strict=True):
                            column.append(value)
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens"])

    pieces = documents(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(frugal(run), SCHEMA)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2("length").cast("int"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences by bucket: one folder ``length=...`` for each power of two."""
    pieces.select("sequence_id", "doc_id", "start", "ids", "length").write.partitionBy("length").parquet(path)


def unpack_ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()
