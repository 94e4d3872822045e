"""Document fingerprints: content-defined chunks of the normalised text, as digests with their lengths.

A gear hash of the last bytes decides where chunks end, so boundaries move with the text: an insertion only changes
the chunks it touches. Two fingerprints give the containment of one document in another: the length of the chunks of
the one that the other has as well, as a share of all its chunks' length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import non_null_id, place_among, shuffle_partitions, stored, whole

#: Bytes that decide about a boundary, and bits of their hash that must be zero: chunks of 32 bytes on average.
WINDOW, BITS = 8, 5
_GEAR = np.frombuffer(hashlib.shake_128(b"gear").digest(1024), np.uint32)
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")
#: One chunk in a fingerprint: digest and length.
_CHUNK = np.dtype([("digest", "<u4"), ("bytes", "<u2")])
#: The longest chunk; where the text has no boundary for as many bytes, as in a long run of one byte, a chunk ends there.
MOST = 4096


def normalise(text: str) -> bytes:
    """A-Z lower-cased and runs of ASCII white space made one blank, so that neither moves a boundary."""
    return _BLANKS.sub(b" ", text.encode().lower()).strip()


def boundaries(data: bytes) -> np.ndarray:
    """Ends of the chunks. The hash of WINDOW bytes is summed by doubling: each step joins two halves."""
    if not data:
        return np.zeros(0, np.int64)
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:
        later = h[width:] + (h[:-width] << np.uint32(width))
        h = np.concatenate([h[:width], later])
        width *= 2
    cut = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    ends = np.append(cut[cut < len(data)], len(data))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > MOST:  # as in long runs of one byte
        extra = [np.arange(e - g + MOST, e, MOST) for e, g in zip(ends, gaps, strict=True) if g > MOST]
        ends = np.unique(np.concatenate([ends, *extra]))
    return ends


def fingerprint(text: str) -> str:
    """Base64 of the distinct chunks by digest; of a repeated chunk the length is that of one."""
    data, start, found = normalise(text), 0, {}
    for end in boundaries(data).tolist():
        found[xxhash.xxh32_intdigest(data[start:end])] = end - start
        start = end
    return base64.b64encode(np.array(sorted(found.items()), _CHUNK).tobytes()).decode() if found else ""


def containment(a: str, b: str) -> float:
    """How much of the chunks of `a`, by length, `b` has: 0 to 1. Nothing contains the empty document but itself."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(base64.b64decode(s), _CHUNK) for s in (a, b))
    if not len(x):
        return 0.0
    return float(x["bytes"][np.isin(x["digest"], y["digest"])].sum(dtype=np.int64) / x["bytes"].sum(dtype=np.int64))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, fingerprint. A null text counts as empty, whose fingerprint is the
    empty string. Other columns are ignored."""
    rows = whole(docs, id_col, text_col)
    schema = T.StructType(
        [T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())]
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns = [pa.array(map(len, texts), pa.int64()), pa.array(map(fingerprint, texts), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return rows.mapInArrow(make, schema)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows cut into ranges of the identifier: range, id, text, last; each range ends with a copy of the row that
    follows it (`last` is true there), after the last range the first row of all.

    The cuts are quantiles, so no range is long, and only one row for each range is looked at twice.
    """
    rows = whole(docs, id_col, text_col).select(non_null_id().alias("id"), "doc_id", "text")
    parts = shuffle_partitions(docs.sparkSession)
    wanted = [k / parts for k in range(1, parts)] or [0.5]
    cuts = rows.agg(F.percentile_approx("id", wanted, 100 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    rows = rows.withColumn("range", place_among(cuts, F.col("id")).cast("long"))
    # Of rows that repeat the range's least identifier the first by text is the one that another range is followed by.
    heads = stored(rows.groupBy("range").agg(F.min("id").alias("id")))
    ranges = sorted((r[0], r[1]) for r in heads.collect())
    follows = {b[0]: a[0] for a, b in zip(ranges, ranges[1:] + ranges[:1], strict=True)}
    if not ranges:
        return rows.select("range", "id", "doc_id", "text", F.lit(False).alias("last"))
    pairs = docs.sparkSession.createDataFrame([(at, follows[r], r) for r, at in ranges], "id long, before long, range long")
    copies = (
        rows.join(F.broadcast(pairs), ["id", "range"])
        .groupBy("before", "id")
        .agg(F.min_by("doc_id", "text").alias("doc_id"), F.min("text").alias("text"))
        .select(F.col("before").alias("range"), "id", "doc_id", "text", F.lit(True).alias("last"))
    )
    return rows.select("range", "id", "doc_id", "text", F.lit(False).alias("last")).unionByName(copies)


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next identifier (after the last the first; a table of one row follows itself);
    rows that repeat an identifier follow each other by text. A null text counts as empty, a null identifier as the
    smallest. The likeness is the containment of the document in the other. Equal texts have equal fingerprints. An
    empty table gives an empty result; other columns are ignored.
    """
    rows = with_next(docs, id_col=id_col, text_col=text_col)
    rows = rows.repartition("range").sortWithinPartitions("range", "last", "id", "text")
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # doc_id, text and fingerprint of the row that waits for the next
        for batch in batches:
            out = []
            for doc_id, text, last in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                own = fingerprint(text)
                if held is not None:
                    changed = edited(held[1], text)
                    other = fingerprint(changed)
                    out.append(
                        (
                            held[0],
                            len(held[1]),
                            hashlib.sha256(changed.encode()).hexdigest(),
                            held[2],
                            other,
                            containment(held[2], other),
                            containment(held[2], own),
                        )
                    )
                held = None if last else (doc_id, text, own)
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            arrays = [pa.array(c, t) for c, t in zip(columns, pa_types(batch), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def pa_types(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.column(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    return rows.mapInArrow(compare, schema)
