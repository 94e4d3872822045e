"""Language-model scores from a hierarchical Pitman-Yor model, whose seating is sampled by Gibbs sweeps.

Each token sits in the restaurant of the token before it (the first one in that of the end token). The tables of these
restaurants are the customers of the restaurant of words, which takes its base from restaurants of byte contexts: each
of its tables spells its word as customers of the contexts of two bytes, whose tables are customers of the contexts of
one and no byte, and last of the uniform distribution. So contexts share their parents, and unseen words have the
probability of their spelling. Customers of one kind are reseated together, given all other seating as of the sweep
before; each sweep reseats every pair of tokens and every word of the corpus. Predictive probabilities are averaged
over the sweeps after the first.

Counts cover all training documents and grow with them, so they stay distributed. Documents are coded by the sorted
vocabulary of their block (a bounded run of one task's documents). A block cuts its words and pairs of tokens by the
range of their hash and sends each range as one packed chunk; a range adds up what all blocks sent and answers in the
order of the chunk, so that an answer costs a few bits. Seats are drawn by hashes of the pair and the sweep: every
block that holds a pair draws the same tables for it, so pairs move once, whatever the number of sweeps, and scores
depend on neither blocks nor partitions. Of a sweep only sums by word move. Blocks stay where they are, bucketed.

Only the byte restaurants reach the driver and are broadcast. A kind is a byte and its two bytes of context, so there
are at most 2^24 of them, however large the corpus. Words are compared in full, pairs by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed_table, shuffle_partitions, stored_table, unstored

#: Tokens after which a task begins a new block; a document is never cut.
BLOCK_TOKENS = 1_500_000
#: Bytes of context.
CONTEXT = 2
STRENGTH = 1.0
#: From this customer on, the customers of one kind are seated in groups of a fifth of those before.
EXACT = 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (64 bits, unsigned)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(keys: np.ndarray, salt: int) -> np.ndarray:
    return mixed(keys.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """One number in [0, 1) for each key and step; two steps share a hash."""
    return _half(keyed(keys, step // 2 + 1), step)


def _half(hashes: np.ndarray, step: int) -> np.ndarray:
    part = hashes & np.uint64(0xFFFFFFFF) if step % 2 else hashes >> np.uint64(32)
    return part * 2.0**-32


def binomial(n: np.ndarray, p: np.ndarray, keys: np.ndarray, step: int) -> np.ndarray:
    """Drawn by inversion, from the normal distribution where 30 or more are expected."""
    flip = p > 0.5
    p = np.clip(np.where(flip, 1 - p, p), 0, 0.5)
    u, out = uniform(keys, step), np.zeros(len(n), np.int64)
    few = np.flatnonzero(n * p < 30)
    m, q, at, k = n[few], p[few], few, 0
    chance = np.exp(m * np.log1p(-q))
    below = chance.copy()
    while len(at):
        more = (u[at] > below) & (k < m)
        at, m, q, chance, below = at[more], m[more], q[more], chance[more], below[more]
        chance = chance * (m - k) / (k + 1) * q / (1 - q)
        below, k = below + chance, k + 1
        out[at] = k
    many = np.flatnonzero(n * p >= 30)
    angle = uniform(mixed(keys[many].astype(np.uint64)), step)
    z = np.sqrt(-2 * np.log(np.maximum(u[many], 1e-300))) * np.cos(2 * np.pi * angle)
    out[many] = np.clip(np.rint(n[many] * p[many] + z * np.sqrt(n[many] * p[many] * (1 - p[many]))), 0, n[many])
    return np.where(flip, n - out, out)


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)) if ones else 0.5


def seat(customers: np.ndarray, pull: np.ndarray, d: float, keys: np.ndarray) -> np.ndarray:
    """Tables of each kind after its customers sat down one by one, drawn by its key; `pull` weighs a new table:
    (strength + discount * all tables) * parent's probability. From the EXACT-th customer on they come in groups, for
    which the chance is averaged, so that frequent kinds take steps as the logarithm of their customers."""
    order = np.argsort(-customers, kind="stable")  # so that those who still sit down are always the first ones
    customers, pull, keys = customers[order], pull[order], keys[order].astype(np.uint64)
    tables, seated, step, hashes = (customers > 0).astype(np.int64), 1, 0, None
    while left := int(np.searchsorted(-customers, -seated)):  # how many have more customers than are seated
        group = 1 if seated < EXACT else seated // 5
        own, t = pull[:left], tables[:left]
        others = np.maximum(seated - d * t, 1e-9)
        if group == 1:
            hashes = keyed(keys[:left], step // 2 + 1) if step % 2 == 0 else hashes[:left]
            t += _half(hashes, step) * (own + others) < own
        else:
            n = np.minimum(group, customers[:left] - seated)
            chance = own / (own + others)
            for _ in range(2):  # the tables that the group itself adds count half
                rest = own + others - 0.5 - d * n * chance / 2
                chance = np.minimum(own / n * np.log1p(n / rest), 1)
            t += binomial(n, chance, keys[:left], step)
        seated, step = seated + group, step + 1
    out = np.empty_like(tables)
    out[order] = tables
    return out


class Spelling:
    """The byte restaurants: kinds (context and byte) by level, sorted, with their customers and tables."""

    def __init__(self, kinds: np.ndarray, customers: np.ndarray, seed: int, sweeps: int = 3):
        self.top = CONTEXT + 1
        self.kinds, self.customers, self.tables = [None] * (self.top + 1), [None] * (self.top + 1), [None] * (self.top + 1)
        self.discounts = [0.5] * (self.top + 1)
        at = (kinds, customers)
        for level in range(self.top, 0, -1):  # at first each kind has one table
            self.kinds[level], self.customers[level] = at
            self.tables[level] = np.ones(len(at[0]), np.int64)
            at = self._parents(level)
        for sweep in range(sweeps):
            self._totals()
            for level in range(self.top, 0, -1):
                c = self.customers[level]
                d = self.discounts[level] = discount((c == 1).sum(), (c == 2).sum())
                total = self.total[level][1][self._context(level, self.kinds[level])[0]]
                pull = (STRENGTH + d * total) * self.probability(self.kinds[level] & ((1 << 8 * (level - 1)) - 1), level - 1)
                self.tables[level] = seat(c, pull, d, keyed(self.kinds[level], (seed * sweeps + sweep) * 8 + level))
                if level > 1:
                    self.customers[level - 1] = self._parents(level)[1]
            self._totals()

    @staticmethod
    def _merged(kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(kinds, return_inverse=True)
        return own, np.bincount(at, counts, len(own)).astype(np.int64)

    def _parents(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        return self._merged(self.kinds[level] & ((1 << 8 * (level - 1)) - 1), self.tables[level])

    def _totals(self) -> None:
        """Of each context its customers and tables."""
        self.contexts, self.total = [None], [None]
        for level in range(1, self.top + 1):
            own, at = np.unique(self.kinds[level] >> 8, return_inverse=True)
            self.contexts.append(own)
            self.total.append([np.bincount(at, x[level], len(own)) for x in (self.customers, self.tables)])

    def _context(self, level: int, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.contexts[level], kinds >> 8)

    def probability(self, kinds: np.ndarray, level: int | None = None) -> np.ndarray:
        """Of the last byte after the bytes before it, of which each level looks at one less."""
        level = self.top if level is None else level
        p = np.full(len(kinds), 1 / 256)
        for k in range(1, level + 1 if len(self.kinds[1]) else 1):
            own = kinds & ((1 << 8 * k) - 1)
            at, known = _find(self.kinds[k], own)
            context, seen = self._context(k, own)
            d = self.discounts[k]
            sits = np.where(known, self.customers[k][at] - d * self.tables[k][at], 0)
            n, t = (np.where(seen, x[context], 0) for x in self.total[k])
            p = np.where(seen, (sits + (STRENGTH + d * t) * p) / (STRENGTH + n), p)
        return p

    def words(self, words: pa.Array) -> np.ndarray:
        """Logarithms, since long words have less than the least double."""
        kinds, owner = spelled(words)
        own, at = distinct(kinds)
        return np.bincount(owner, np.log(self.probability(own))[at], len(words))


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The kinds of all bytes of the words, a blank ending each, and the word that each belongs to."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    full = size + CONTEXT + 1
    end = np.cumsum(full)
    data = np.zeros(int(end[-1]) if len(end) else 0, np.int64)
    data[end - 1] = 32
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    inside = np.ones(len(data), bool)
    for k in range(CONTEXT):
        inside[end - full + k] = False
    letter = inside.copy()
    letter[end - 1] = False
    data[letter] = raw
    kinds = data.copy()
    for k in range(1, CONTEXT + 1):
        kinds[k:] |= data[:-k] << 8 * k
    return kinds[inside], np.repeat(np.arange(len(size)), size + 1)


def distinct(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with the inverse; many kinds are looked up in a table of all, which is faster than sorting them."""
    if len(kinds) < 100_000:
        return np.unique(kinds, return_inverse=True)
    place = np.zeros(1 << 8 * (CONTEXT + 1), np.int32)
    place[kinds] = 1
    own = np.flatnonzero(place)
    place[own] = np.arange(len(own), dtype=np.int32)
    return own, place[kinds]


def pack(values: np.ndarray) -> bytes:
    """Byte by byte: the lowest bytes of all values, then the next ones, as many as the largest value has, which a
    first byte says. Values aren't negative."""
    size = values.itemsize
    if values.dtype.kind in "iu":
        size = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([size]) + np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)[:, :size].T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size, width = data[0], np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(size, -1)
    out = np.zeros((planes.shape[1], width), np.uint8)
    out[:, :size] = planes.T
    return out.view(kind).ravel()


def _packed_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def _sorted_unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _split(words: bytes) -> list[bytes]:
    return words.split(b"\n")


def _joined(words: pa.Array) -> pa.Array:
    """One row, which _split() takes apart faster than to_pylist() would."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b"\n")


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _ranges(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Where each of the equal ranges of hashes lies in these sorted ones, without empty ranges."""
    part = (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    found, start = np.unique(part, return_index=True)
    yield from zip(found.tolist(), map(slice, start, np.append(start[1:], len(hashes))), strict=True)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Words:
    """The tokens of a block's documents, gathered in arrays and then numbered at once."""

    def __init__(self) -> None:
        self.arrays: list[pa.Array] = []
        self.last: list[bytes] = []

    def add(self, words: list[bytes]) -> int:
        """Add a document, which the end token ends; the number of its tokens."""
        self.last += words
        self.last.append(b"")
        if len(self.last) >= 100_000:
            self._pass()
        return len(words) + 1

    def _pass(self) -> None:
        self.arrays.append(pa.array(self.last, pa.binary()))
        self.last = []

    def numbered(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words in the order in which they first occur, and the place of each token among them."""
        self._pass()
        found = pa.concat_arrays(self.arrays).dictionary_encode()
        return found.dictionary, found.indices.to_numpy()


def _coded(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """One row for each block: its documents, their tokens as numbers, and its words in the order of their hashes, by
    which they are numbered, with their training counts."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    schema = (
        T.StructType()
        .add("block", T.LongType())
        .add("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType))
        .add("sizes", T.ArrayType(T.IntegerType()))
        .add("learns", T.ArrayType(T.BooleanType()))
        .add("ids", T.BinaryType())
        .add("words", T.BinaryType())
        .add("hashes", T.BinaryType())
        .add("counts", T.BinaryType())
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        words, docs, tokens, kind = Words(), [], 0, None

        def coded() -> pa.RecordBatch:
            doc_ids, learns, sizes = zip(*docs, strict=True)
            known, numbers = words.numbered()
            hashes = _hashes(_split(_joined(known)[0].as_py()))
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            ids = rank[numbers]
            counts = np.bincount(ids[np.repeat(np.array(learns), sizes)], minlength=len(order))
            row = [
                pa.array([block], pa.int64()),
                pa.array([list(doc_ids)], pa.list_(kind)),
                pa.array([list(sizes)], pa.list_(pa.int32())),
                pa.array([list(learns)], pa.list_(pa.bool_())),
                pa.array([pack(ids)], pa.binary()),
                _joined(known.take(pa.array(order))),
                *(pa.array([x], pa.binary()) for x in (_packed_sorted(hashes[order]), pack(counts.astype(np.int64)))),
            ]
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text, learns in zip(*batch.columns, strict=True):
                size = words.add(text.as_py().lower().split())
                docs.append((doc_id.as_py(), learns.as_py(), size))
                tokens += size
                if tokens >= BLOCK_TOKENS:
                    yield coded()
                    words, docs, tokens, block = Words(), [], 0, block + 1
        if docs:
            yield coded()

    return bucketed_table(rows.mapInArrow(code, schema), "block")


def _sorted_distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, the place of each among them, and where each occurs. Places in the low bits make
    one sort of numbers do; hashes whose high bits are equal but which differ take the longer way."""
    n, low = len(hashes), np.uint64(max(1, len(hashes).bit_length()))
    mask = (np.uint64(1) << low) - np.uint64(1)
    both = np.sort((hashes & ~mask) | np.arange(n, dtype=np.uint64))
    at = (both & mask).astype(np.int64)
    first = np.ones(n, bool)
    first[1:] = both[1:] >> low != both[:-1] >> low
    rank = np.cumsum(first) - 1
    some = at[first]
    own = hashes[some]
    place = np.empty(n, np.int64)
    place[at] = rank
    if (own[place] != hashes).any():
        own, place = np.unique(hashes, return_inverse=True)
        some = np.empty(len(own), np.int64)
        some[place] = np.arange(n)
    return own, place, some


class Block:
    """A row of the coded documents, with its distinct pairs of tokens in the order of their hashes."""

    def __init__(self, sizes: np.ndarray, ids: bytes, hashes: bytes):
        self.sizes, self.ids, self.hashes = sizes.astype(np.int64), unpack(ids, np.int32), _sorted_unpacked(hashes)
        ends = np.cumsum(self.sizes)
        before = np.roll(self.ids, 1)
        before[ends - self.sizes] = self.ids[ends - 1]  # before the first token is the end token, the last one
        first, second = mixed(self.hashes), self.hashes * np.uint64(0x9E3779B97F4A7C15)
        self.pairs, self.at, some = _sorted_distinct(mixed(first[before] + second[self.ids]))
        self.before, self.word = before[some], self.ids[some]

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, row: int = 0) -> Block:
        return cls(table["sizes"][row].values.to_numpy(), table["ids"][row].as_py(), table["hashes"][row].as_py())


_PARTS = "part long, block long, "


def _lexicon(coded: DataFrame, parts: int) -> DataFrame:
    """By range of the words' hashes: one row with the words and their training counts (no block), and for each block
    the places of its words among them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, joined, counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                words, counts = _split(joined), unpack(counts, np.int64)
                rows = [(part, block, b"\n".join(words[at]), pack(counts[at])) for part, at in _ranges(_hashes(words), parts)]
                yield pa.RecordBatch.from_pylist([dict(zip(("part", "block", "words", "counts"), r, strict=True)) for r in rows])

    def merge(rows: pa.Table) -> pa.Table:
        rows, numbers, each, total = rows.sort_by("block"), _Numbers(), [], []
        for block, joined, counts in zip(*(rows[c].to_pylist() for c in ("block", "words", "counts")), strict=True):
            words = _split(joined)
            each.append((block, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
            total.append(unpack(counts, np.int64))
        total = np.bincount(np.concatenate([x for _, x in each]), np.concatenate(total)).astype(np.int64)
        words = [b"\n".join(numbers), *[None] * len(each)]
        filled = [pack(total), *[pack(x) for _, x in each]]
        return pa.table([[rows["part"][0].as_py()] * len(words), [None, *[b for b, _ in each]], words, filled], schema=out)

    out = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("numbers", pa.binary())])
    cut_ = coded.select("block", "words", "counts").mapInArrow(cut, _PARTS + "words binary, counts binary")
    return bucketed_table(cut_.groupBy("part").applyInArrow(merge, _PARTS + "words binary, numbers binary"), "part")


def _pair_counts(coded: DataFrame, parts: int) -> DataFrame:
    """For each block and range of the pairs' hashes, twice the pairs' training counts over all blocks, and one more in
    the block that speaks for the pair; for each range how many pairs occur once and twice (no block)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = Block.of(batch, row)
                learns = np.repeat(batch["learns"][row].values.to_numpy(zero_copy_only=False), own.sizes)
                counts = np.bincount(own.at[learns], minlength=len(own.pairs))
                rows = [(part, _packed_sorted(own.pairs[at]), pack(counts[at])) for part, at in _ranges(own.pairs, parts)]
                block = batch["block"][row].as_py()
                yield pa.RecordBatch.from_pylist([{"part": p, "block": block, "pairs": h, "counts": c} for p, h, c in rows])

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        pairs = [_sorted_unpacked(x) for x in rows["pairs"].to_pylist()]
        counts = np.concatenate([unpack(x, np.int64) for x in rows["counts"].to_pylist()])
        ends = np.cumsum([len(x) for x in pairs])
        own, at = np.unique(np.concatenate(pairs), return_inverse=True)
        speaks = np.empty(len(own), np.int64)
        speaks[at] = np.arange(len(at))
        total = np.bincount(at, counts).astype(np.int64)
        heard = total[at] * 2
        heard[speaks] += 1
        blocks = [None, *rows["block"].to_pylist()]
        few = np.array([(total == 1).sum(), (total == 2).sum()])
        data = [pack(few), *map(pack, np.split(heard, ends[:-1]))]
        return pa.table([[rows["part"][0].as_py()] * len(data), blocks, data], schema=out)

    out = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
    sent = coded.select("block", "sizes", "learns", "ids", "hashes").mapInArrow(cut, _PARTS + "pairs binary, counts binary")
    return stored_table(sent.groupBy("part").applyInArrow(merge, _PARTS + "data binary"), "zstd")


class Level:
    """What a sweep left in the restaurant of words: its spelling, discount, tables, customers and number (sweep)."""

    def __init__(self, sweep: int, spelling: Spelling, d: float, tables: int, customers: int):
        self.sweep, self.spelling, self.d, self.customers = sweep, spelling, d, customers
        self.pull = STRENGTH + d * tables

    def chance(self, base: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Logarithms of the words' probabilities, given those of their spelling."""
        with np.errstate(divide="ignore"):
            sits = np.log(np.maximum(customers - self.d * tables, 0)) - np.log(STRENGTH + self.customers)
        return np.logaddexp(sits, np.log(self.pull) + base - np.log(STRENGTH + self.customers))


def _lexicon_of(rows: pa.Table) -> tuple[pa.Array, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Of a range: its words, their training counts, and for each block the places of its words."""
    filled = zip(*(rows[c].to_pylist() for c in ("block", "words", "numbers")), strict=True)
    words, total, each = pa.array([], pa.binary()), np.empty(0, np.int64), []
    for block, joined, numbers in filled:
        if block is None:
            words, total = pa.array(_split(joined), pa.binary()), unpack(numbers, np.int64)
        else:
            each.append((block, unpack(numbers, np.int32)))
    return words, total, each


def _values(lexicon: DataFrame, state: DataFrame, level: Level) -> DataFrame:
    """For each block and range after a sweep: the logarithms of its words' probabilities, the tables after them, and
    how often they occur in training."""
    shared = lexicon.sparkSession.sparkContext.broadcast(level)

    def value(known: pa.Table, states: pa.Table) -> pa.Table:
        words, total, each = _lexicon_of(known)
        rows = []
        for state in states.to_pylist() if len(words) else []:
            level = shared.value
            customers, tables, after = (unpack(state[c], np.int64) for c in ("customers", "tables", "after"))
            chance = level.chance(level.spelling.words(words), customers, tables).astype(np.float32)
            for block, at in each:
                rows.append((block, state["part"], level.sweep, pack(chance[at]), pack(after[at]), pack(total[at])))
        return pa.table(list(zip(*rows, strict=True)) or [[]] * 6, schema=out)

    names = ["block", "part", "sweep", "data", "after", "total"]
    out = pa.schema(list(zip(names, [pa.int64()] * 3 + [pa.binary()] * 3, strict=True)))
    kinds = "block long, part long, sweep long, data binary, after binary, total binary"
    return lexicon.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(value, kinds)


#: Stands for the sweep in rows with the counts of pairs; below it are the tables of pairs after a sweep.
PAIRS = -1


def _received(rows: pa.Table, sweep: int, column: str, kind: type) -> np.ndarray:
    """What was sent to a block, in the order of its words or of its pairs."""
    rows = rows.filter(pc.equal(rows["sweep"], sweep)).sort_by("part")
    return np.concatenate([np.empty(0, kind), *(unpack(x, kind) for x in rows[column].to_pylist())])


def _pair_tables(own: Block, count: np.ndarray, received: pa.Table, sweep: int, d: float) -> np.ndarray:
    """Tables of the block's pairs after the sweep; before the first each pair has one."""
    tables = (count > 0).astype(np.int64)
    if sweep:
        many = np.flatnonzero(count > 1)
        chance, after = (_received(received, sweep - 1, c, k) for c, k in (("data", np.float32), ("after", np.int64)))
        pull = (STRENGTH + d * after[own.before[many]]) * np.exp(chance[own.word[many]].astype(np.float64))
        tables[many] = seat(count[many], pull, d, keyed(own.pairs[many], sweep))
    return tables


def _sums(coded: DataFrame, sent: DataFrame, sweep: int, d: float, parts: int) -> DataFrame:
    """For each range and block: tables after its words and tables that end in them, of the pairs it speaks for. For
    each block: the tables of its pairs (no range)."""

    def add(texts: pa.Table, received: pa.Table) -> pa.Table:
        rows = []
        if texts.num_rows:
            own, heard, block = Block.of(texts), _received(received, PAIRS, "data", np.int64), texts["block"][0].as_py()
            tables = _pair_tables(own, heard >> 1, received, sweep, d)
            after, within = (np.bincount(x, tables * (heard & 1), len(own.hashes)).astype(np.int64) for x in (own.before, own.word))
            rows = [(part, block, pack(after[at]), pack(within[at]), None) for part, at in _ranges(own.hashes, parts)]
            rows += [(None, block, None, None, pack(tables))] if sweep else []
        return pa.table(list(zip(*rows, strict=True)) or [[]] * 5, schema=out)

    out = pa.schema([("part", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("after", "within", "tables"))])
    texts = coded.select("block", "sizes", "ids", "hashes")
    sums = texts.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(add, _PARTS + "after binary, within binary, tables binary")
    return stored_table(sums, "zstd")


def _seated(lexicon: DataFrame, sums: DataFrame, sweep: int, level: Level | None) -> DataFrame:
    """The state of the words after a sweep: their customers (tables that end in them), tables, and tables after them."""
    shared = lexicon.sparkSession.sparkContext.broadcast(level)

    def reseat(known: pa.Table, sums: pa.Table) -> pa.Table:
        words, total, each = _lexicon_of(known)
        after, customers = (np.zeros(len(words), np.int64) for _ in range(2))
        for row in sums.to_pylist():
            at = dict(each)[row["block"]]
            after[at] += unpack(row["after"], np.int64)
            customers[at] += unpack(row["within"], np.int64)
        tables = np.minimum(customers, 1)
        many = np.flatnonzero(customers > 1)
        if shared.value is not None and len(many):
            some = words.take(pa.array(many))
            pull = shared.value.pull * np.exp(shared.value.spelling.words(some))
            tables[many] = seat(customers[many], pull, shared.value.d, keyed(_hashes(some.to_pylist()), sweep))
        return pa.table([[known["part"][0].as_py()], [sweep], *([pack(x)] for x in (customers, tables, after))], schema=out)

    out = pa.schema([("part", pa.int64()), ("sweep", pa.int64()), *((c, pa.binary()) for c in ("customers", "tables", "after"))])
    kinds = "part long, sweep long, customers binary, tables binary, after binary"
    return stored_table(lexicon.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(reseat, kinds), "zstd")


#: Sums that come with the counts of kinds, which aren't negative.
EATERS, TABLES, ONES, TWOS, TOKENS, DISTINCT = range(-6, 0)


def kind_counts(words: pa.Array, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kinds that the tables of these words spell, and how often."""
    found, owner = spelled(words)
    own, at = distinct(found)
    return own, np.bincount(at, tables[owner], len(own)).astype(np.int64)


def _level(lexicon: DataFrame, state: DataFrame, sweep: int) -> tuple[Level, int, int]:
    """The restaurant of words after a sweep; and the training tokens, in all and distinct."""

    def count(known: pa.Table, states: pa.Table) -> pa.Table:
        words, total, _ = _lexicon_of(known)
        customers, tables = (unpack(states[c][0].as_py(), np.int64) for c in ("customers", "tables"))
        spelt = np.flatnonzero(tables)
        kinds, counts = kind_counts(words.take(pa.array(spelt)), tables[spelt])
        sums = {EATERS: customers.sum(), TABLES: tables.sum(), ONES: (customers == 1).sum(), TWOS: (customers == 2).sum(), TOKENS: total.sum(), DISTINCT: (total > 0).sum()}
        return pa.table([np.append(kinds, list(sums)), np.append(counts, list(sums.values()))], names=["kind", "customers"])

    found = lexicon.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(count, "kind long, customers long")
    table = found.groupBy("kind").agg(F.sum("customers").alias("customers")).toArrow().sort_by("kind")
    kinds, counts = (x.to_numpy() for x in table.columns)
    sums = dict(zip(kinds[kinds < 0].tolist(), counts.tolist(), strict=False))
    spelling = Spelling(kinds[kinds >= 0], counts[kinds >= 0], sweep)
    level = Level(sweep, spelling, discount(sums.get(ONES, 0), sums.get(TWOS, 0)), sums.get(TABLES, 0), sums.get(EATERS, 0))
    return level, sums.get(TOKENS, 0), sums.get(DISTINCT, 0)


def _left_over(lexicon: DataFrame, levels: list[Level]) -> list[float]:
    """Of each sweep, the logarithm of what the spellings of the known words leave of the base, as a class of its own."""
    shared = lexicon.sparkSession.sparkContext.broadcast([x.spelling for x in levels])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for joined, numbers in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                words = pa.array(_split(joined), pa.binary()).filter(pa.array(unpack(numbers, np.int64) > 0))
                sums = [float(np.exp(x.words(words)).sum()) if len(words) else 0.0 for x in shared.value]
                yield pa.RecordBatch.from_arrays([pa.array([sums])], names=["known"])

    rows = lexicon.where("block IS NULL").select("words", "numbers").mapInArrow(known, "known array<double>")
    rows = rows.select(F.posexplode("known").alias("at", "known")).groupBy("at").agg(F.sum("known").alias("known"))
    sums = {r[0]: r[1] for r in rows.collect()}
    return [np.log(x.pull * max(1 - sums.get(k, 0.0), 1e-300) / (STRENGTH + x.customers)) for k, x in enumerate(levels)]


def lm_scores(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 2) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score, open_score.

    Learns from rows where `train` holds. Tokens are words (runs without ASCII white space, A-Z lower-cased) and one
    end; a null or empty text has the end only. n_known counts tokens that occur in training; base_score is the
    add-one unigram log10 probability with one class for unknown tokens, and `score` the model's over the same
    outcomes, each after the token before it: the class has what the spellings of the known words leave of the base.
    `open_score` spells unknown words out instead. Without training rows every byte has the same chance. Null and
    repeated identifiers are given back as they are; repeated rows count each. An empty table gives an empty result;
    other columns are ignored.
    """
    coded = _coded(docs, train, id_col, text_col)
    parts = max(shuffle_partitions(docs.sparkSession), coded.count())  # so that a range is no larger than a block
    lexicon = _lexicon(coded, parts)
    pairs = _pair_counts(coded, parts)
    few = [unpack(r[0], np.int64) for r in pairs.where("block IS NULL").select("data").toLocalIterator()]
    pair_d = discount(*np.sum([np.zeros(2), *few], axis=0))
    heard = pairs.where("block IS NOT NULL").select("block", "part", F.lit(-1).cast("long").alias("sweep"), "data")
    levels, sent, averaged = [], heard, heard
    for sweep in range(sweeps + 1):
        sums = _sums(coded, sent, sweep, pair_d, parts)
        state = _seated(lexicon, sums.where("part IS NOT NULL").drop("tables"), sweep, levels[-1] if levels else None)
        level, n, distinct = _level(lexicon, state, sweep)
        levels.append(level)
        values = stored_table(_values(lexicon, state, level), "zstd")
        sent = heard.unionByName(values, allowMissingColumns=True)
        if sweep:
            own = sums.where("part IS NULL").select("block", F.lit(0).cast("long").alias("part"), F.lit(PAIRS - sweep).cast("long").alias("sweep"), F.col("tables").alias("data"))
            averaged = averaged.unionByName(own, allowMissingColumns=True).unionByName(values, allowMissingColumns=True)
    unknown = _left_over(lexicon, levels[1:])
    schema = (
        T.StructType().add("doc_id", coded.schema["doc_ids"].dataType.elementType).add("n_tokens", T.LongType())
        .add("n_known", T.LongType()).add("train_tokens", T.LongType()).add("base_score", T.DoubleType())
        .add("score", T.DoubleType()).add("open_score", T.DoubleType())
    )

    def score(texts: pa.Table, received: pa.Table) -> pa.Table:
        own, count = Block.of(texts), _received(received, PAIRS, "data", np.int64) >> 1
        total = _received(received, 1, "total", np.int64)
        sums, most = np.zeros((2, len(count))), np.full(len(count), -np.inf)
        for sweep, rest in enumerate(unknown, 1):
            chance, after = (_received(received, sweep, c, k) for c, k in (("data", np.float32), ("after", np.int64)))
            sits = count - pair_d * _received(received, PAIRS - sweep, "data", np.int64)
            back = STRENGTH + pair_d * after[own.before]
            spelt = chance.astype(np.float64)
            for k, x in enumerate((np.where(total > 0, spelt, rest), spelt)):
                sums[k] += sits + back * np.exp(x)[own.word]
            most = np.maximum(most, np.log(back) + spelt[own.word])  # where long words have less than the least double
        with np.errstate(divide="ignore"):
            outcomes = np.maximum(np.log(sums), most)
        given = (outcomes - np.log(sweeps) - np.log(STRENGTH + total[own.before])) / np.log(10)
        base = np.log10((total + 1) / (n + distinct + 1))
        owner = np.repeat(np.arange(len(own.sizes)), own.sizes)
        sums = [np.bincount(owner, x, len(own.sizes)) for x in ((total > 0)[own.ids], base[own.ids], *given[:, own.at])]
        return pa.table(
            [texts["doc_ids"].combine_chunks().flatten(), pa.array(own.sizes), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(own.sizes), n)), *map(pa.array, sums[1:])],
            names=schema.names,
        )

    texts = coded.select("block", "doc_ids", "sizes", "ids", "hashes")
    return texts.groupBy("block").cogroup(averaged.groupBy("block")).applyInArrow(score, schema)
