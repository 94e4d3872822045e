"""Byte-level BPE encoding and decoding of documents, from a rank file and a splitting pattern."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import whole
from .prefix_bpe import Memo, PrefixBpe, ends

#: Unicode White_Space, spelled out because libraries differ about \s.
WHITE = "\t-\r \x85\xa0  -     　"
#: Units no pattern match crosses: a run without white space with the one blank before it, or white space. Units
#: are found faster than matches and repeat as often, so results are remembered by unit.
UNITS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: How far past its end a match of the pattern may look.
LOOK = 3


class Table:
    """Byte strings by number, joined by one gather."""

    def __init__(self, strings: list[bytes]):
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(x) for x in strings], np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size

    def join(self, numbers: np.ndarray) -> bytes:
        size = self.size[numbers]
        at = np.repeat(self.start[numbers] - np.cumsum(size, dtype=np.int32) + size, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.blob[at].tobytes()


class ByteBpe:
    """Encode and decode like the tiktoken library without special tokens; matches are encoded separately."""

    def __init__(self, path: str, pattern: str, limit: int = 120_000):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.dp = PrefixBpe(self.ranks, 0)
        self.rank = [-1, *self.ranks.values()]
        self.units = Memo(self._unit, limit)
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = Table(tokens)
        self.decimals = Table([b"%d " % k for k in range(len(tokens))])

    def piece_ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        known = self.ranks.get(raw)
        return [known] if known is not None else [self.rank[k] for k in self.dp.tokens(self.dp.extend(raw, []))]

    def _unit(self, unit: str) -> bytes:
        # Letters with at most one blank before and one mark behind need no pattern.
        word = unit[1:] if unit[0] == " " else unit
        if word.isalpha():
            pieces = [unit]
        elif word[:-1].isalpha() and word[-1] in ".,:;!?":
            pieces = [unit[:-1], unit[-1]]
        else:
            pieces = self.pattern.findall(unit)
        ids = [i for piece in pieces for i in self.piece_ids(piece)]
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.units.__getitem__, UNITS.findall(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes.join(ids)

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by a blank."""
        return self.decimals.join(ids)[:-1]

    def state(self, text: str) -> TextState:
        return TextState(self, text)


class TextState:
    """A text with its pattern matches and their tokens, which appends and edits bring up to date."""

    def __init__(self, bpe: ByteBpe, text: str):
        self.bpe, self.text = bpe, text
        self.pieces: list[str] = bpe.pattern.findall(text)

    def ids(self) -> list[int]:
        return [i for piece in self.pieces for i in self.bpe.piece_ids(piece)]

    def append(self, more: str) -> TextState:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, put: str) -> TextState:
        """Replace text[start:end]. Matches begin again a little before the edit and stop where an old one begins."""
        old = ends(self.pieces)
        keep = next((k for k, e in enumerate(old) if e + LOOK >= start), len(old))
        at = old[keep - 1] if keep else 0
        self.text = self.text[:start] + put + self.text[end:]
        shift, first = len(put) - (end - start), start + len(put)
        begins = {e + shift: k + 1 for k, e in enumerate(old) if e >= end} if end else {}
        fresh = []
        for match in self.bpe.pattern.finditer(self.text, at):
            if match.start() >= first and match.start() in begins:
                self.pieces[keep:] = fresh + self.pieces[begins[match.start()] :]
                return self
            fresh.append(match[0])
        self.pieces[keep:] = fresh
        return self


@lru_cache(4)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(path, pattern)


def bpe_encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    ids: bool = True,
    digests: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, then ids (array of int) and/or ids_sha256 and decoded_sha256.

    Each document is encoded alone and whole. A null text counts as empty and has no tokens; null and repeated
    identifiers are given back as they are. The digests are of the decimal ids joined by a blank and of the bytes
    that decoding the ids gives. An empty table gives an empty result; other columns are ignored.
    """
    rows = whole(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType())])
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if digests:
        schema = schema.add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            n, found, first, second = [], [], [], []
            for text in batch.column(1):
                own = bpe.encode(text.as_py())
                n.append(len(own))
                if ids:
                    found.append(own)
                if digests:
                    first.append(hashlib.sha256(bpe.decimal(own)).hexdigest())
                    second.append(hashlib.sha256(bpe.decode(own)).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64())]
            if ids:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int32), *found])))
            if digests:
                columns += [pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(encode, schema)


def bpe_decode(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text. Ids that end inside a character give the replacement character there;
    null ids count as none."""
    rows = encoded.selectExpr(f"`{id_col}` AS doc_id", f"coalesce(`{ids_col}`, array()) AS ids")
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(x.as_py(), np.int64)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(decode, schema)
