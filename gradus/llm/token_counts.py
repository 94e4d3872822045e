"""Exact token counts of a sentencepiece BPE model, at every prefix of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .common import whole
from .prefix_bpe import Memo, PrefixBpe

MARK = "▁"


class PieceCounts:
    """Counts as the library's encode() gives them, without begin or end tokens.

    No piece of the vocabulary has the blank mark behind another symbol, or a line feed, which is checked here; so
    text falls into units that no merge crosses, and counts are remembered by unit.
    """

    def __init__(self, path: str, limit: int = 500_000):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        pieces = [p for p in proto.pieces if p.type == kind.NORMAL]
        if any(p.type == kind.USER_DEFINED or p.type == kind.UNUSED for p in proto.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        if proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in pieces):
            raise ValueError("a piece of the vocabulary crosses words")
        rules = proto.normalizer_spec
        plain = not rules.precompiled_charsmap and rules.escape_whitespaces and rules.add_dummy_prefix
        self.identity = plain and not rules.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known = {p.piece for p in pieces}
        self.dp = PrefixBpe({p.piece: -p.score for p in pieces}, limit // 4)
        #: Neighbours inside pieces; no merge joins any other two symbols.
        self.inside = {p.piece[k : k + 2] for p in pieces for k in range(len(p.piece) - 1)}
        self.units = Memo(self._unit, limit)
        self.split = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def normal(self, text: str) -> str:
        if not self.identity:
            return self.library.normalize(text)
        return MARK + text.replace(" ", MARK) if text else ""

    def _prefixes(self, unit: str) -> list[int]:
        """Tokens of each prefix of a unit; a symbol without a piece is one token for each of its bytes."""
        out, start = [0], 0
        for at in range(1, len(unit) + 1):
            if at == len(unit) or unit[at - 1 : at + 1] not in self.inside:
                base, part = out[-1], unit[start:at]
                if len(part) == 1:
                    out.append(base + (1 if part in self.known else len(part.encode())))
                else:  # its symbols all are in the vocabulary or stand alone
                    extra = [0 if x in self.known else len(x.encode()) - 1 for x in part]
                    counts = self.dp.counts(self.dp.states[part])
                    out += [base + n + sum(extra[:k]) for k, n in enumerate(counts[1:], 1)] if any(extra) else [base + n for n in counts[1:]]
                start = at
        return out

    def _unit(self, unit: str) -> int:
        return self._prefixes(unit)[-1]

    def count(self, text: str) -> int:
        return sum(map(self.units.__getitem__, self.split.findall(self.normal(text))))

    def prefixes(self, text: str) -> list[int]:
        """The number of tokens of each prefix of the text, in characters, from the empty one on."""
        if not self.identity:
            raise ValueError("prefixes of normalised text aren't prefixes of the text")
        out = [0]
        for unit in self.split.findall(self.normal(text)):
            out += [out[-1] + n for n in self._prefixes(unit)[1:]]
        return [0, *out[2:]]

    def fit(self, text: str, budget: int) -> tuple[int, int]:
        """Characters of the longest prefix of at most so many tokens, and its tokens."""
        counts = self.prefixes(text)  # not monotone: one more symbol can complete a longer token
        best = max((i for i, n in enumerate(counts) if n <= budget), default=0)
        return best, counts[best]


@lru_cache(4)
def piece_counts(path: str) -> PieceCounts:
    """One for each worker process."""
    return PieceCounts(path)


def token_counts(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, fitting: bool = False
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit; with `fitting` also fit_chars and fit_tokens,
    the longest prefix of at most `limit` tokens.

    Whole texts are counted. A null text counts as empty and has no tokens; null and repeated identifiers are given
    back as they are. An empty table gives an empty result; other columns are ignored.
    """
    rows = whole(docs, id_col, text_col)
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    if fitting:
        schema = schema.add("fit_chars", T.LongType()).add("fit_tokens", T.LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(path)
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py()
                n = counts.count(text)
                row = [len(text.encode()), n, n > limit]
                if fitting:
                    row += [len(text), n] if n <= limit else counts.fit(text, limit)
                out.append(row)
            columns = [pa.array([r[k] for r in out], f) for k, f in enumerate([pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()][: len(schema) - 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return rows.mapInArrow(count, schema)
