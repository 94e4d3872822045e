"""Every operator against a brute-force version over hard rows, on an empty table, and where groups are large."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hard_rows import HARD
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("run_rows", [1, 2048])
def test_exact_dedup(hard, empty, keep, run_rows):
    from gradus.llm.exact_dedup import exact_dedup

    groups = defaultdict(list)
    for i, t in HARD:
        groups[lower(t)].append(-(2**63) if i is None else i)
    got = exact_dedup(hard, keep=keep, run_rows=run_rows).collect()
    want = []
    for i, t in HARD:
        best = (min if keep == "min" else max)(groups[lower(t)])
        want.append((i, None if best == -(2**63) else best, len(groups[lower(t)]), sha(lower(t))))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=key) == sorted(want, key=key)
    assert all(sum(r.kept for r in got if r.text_sha256 == sha(t)) == 1 for t in groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(empty, keep=keep).count() == 0


def test_line_dedup(hard, empty):
    from gradus.llm.line_dedup import line_dedup

    where = defaultdict(set)
    for i, t in HARD:
        for line in (t or "").split("\n"):
            where[lower(line.strip(SPACE))].add(-(2**63) if i is None else i)
    want = []
    for i, t in HARD:
        lines, own = (t or "").split("\n"), -(2**63) if i is None else i
        kept = [x for x in lines if len(k := lower(x.strip(SPACE))) < 10 or own == min(where[k])]
        want.append((i or 0, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [(r.doc_id or 0, r.n_lines, r.n_dropped, r.text) for r in line_dedup(hard, carry=["lang"]).collect()]
    assert sorted(got) == sorted(want)
    assert line_dedup(empty).count() == 0


def test_line_dedup_of_many_lines(table):
    from gradus.llm.line_dedup import line_dedup

    lines = [f"line number {k} of the text" for k in range(400)]
    rows = {r.doc_id: r for r in line_dedup(table([(2, "\n".join(lines)), (1, "\n".join(lines[::3]))])).collect()}
    assert rows[2].n_dropped == len(lines[::3]) and rows[1].n_dropped == 0
    assert rows[2].text == "\n".join(x for k, x in enumerate(lines) if k % 3)


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    import tiktoken

    from gradus.llm.byte_bpe import ByteBpe

    own = ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    return own, library


PARTS = ["a", "the", "'s", "'re", "  ", " ", "\n", "é", "日本", "😀", "1", "½", "\x1c", "\xa0", "▁", "ing", "'", "\r", "<0x0A>", "\x00", "ca", "$$"]


def test_byte_bpe_is_the_library(bpe):
    own, library = bpe
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        ids = own.encode(text)
        assert ids.tolist() == library.encode_ordinary(text) and own.decode(ids) == text.encode()
        assert own.decimal(ids).decode() == " ".join(map(str, ids))
        a, b = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
        state = own.state(text)
        assert state.edit(a, b, "ing").ids() == library.encode_ordinary(text[:a] + "ing" + text[b:])
        assert state.append("'s a").ids() == library.encode_ordinary(state.text)


def test_prefix_states(bpe):
    dp = bpe[0].dp
    text = b"the international hyperthe" * 20
    state = dp.extend(text, [])
    assert [dp.names[k] for k in dp.tokens(state[:9])] == dp.merged(text[:9])
    new, edited = dp.edit(text, state, 30, 33, b"xyz")
    assert edited == dp.extend(new, [])
    assert dp.extend(text + b"ing", list(state)) == dp.extend(text + b"ing", [])


def test_pairs_are_checked_by_undoing_merges(bpe, monkeypatch):
    from gradus.llm import prefix_bpe

    rng, in_turn = random.Random(8), Counter()
    for k in range(400):  # odd ones too: merges in any order, of equal value, or that nothing leads to
        names = ["".join(rng.choices("ab", k=rng.randint(2, 6))) for _ in range(rng.randint(1, 11))]
        order = {x: i if k % 3 else rng.randint(0, 9) for i, x in enumerate(dict.fromkeys(["a", "b", *names]))}
        own = prefix_bpe.PrefixBpe(order)
        in_turn[own.in_turn] += 1
        for first in range(len(own.names)):
            for second in range(1, len(own.names)):
                pair = [x for x in (own.names[first], own.names[second]) if x]
                assert own.stays(first, second) == (own.merged("".join(pair)) == pair), (order, pair)
    assert min(in_turn.values()) > 50 and len(in_turn) == 2
    own, library = bpe
    texts = ["".join(rng.choices("thaeinosrdlé", k=12)) for _ in range(200)]
    monkeypatch.setattr(prefix_bpe, "PAIRS", 50)
    monkeypatch.setattr(own.dp, "pairs", {})
    monkeypatch.setattr(own.dp, "merged", lambda text: pytest.fail("a pair is merged from scratch"))
    assert [own.encode(x).tolist() for x in texts] == [library.encode_ordinary(x) for x in texts]
    assert 0 < len(own.dp.pairs) <= 50


def test_byte_bpe_query(hard, empty, bpe):
    import public_tokenizers

    from gradus.llm.byte_bpe import bpe_decode, bpe_encode

    at = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe_encode(hard, *at, digests=True)
    want = sorted((sha(t or ""), len(bpe[1].encode_ordinary(t or ""))) for _, t in HARD)
    assert sorted((r.decoded_sha256, r.n_tokens) for r in out.collect()) == want
    assert all(r.ids_sha256 == sha(" ".join(map(str, r.ids))) for r in out.collect())
    assert sorted(r.text for r in bpe_decode(out, *at).collect()) == sorted(t or "" for _, t in HARD)
    assert bpe_encode(empty, *at).count() == 0


def test_token_counts(hard, empty):
    import public_tokenizers

    from gradus.llm.token_counts import PieceCounts, token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    counts, rng = PieceCounts(path), random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        each = [len(counts.library.encode(text[:k])) for k in range(len(text) + 1)]
        assert counts.prefixes(text) == each and counts.count(text) == each[-1]
        fit, used = counts.fit(text, 3)
        assert used == each[fit] <= 3 and all(n > 3 for n in each[fit + 1 :])
    got = token_counts(hard, path, limit=20, fitting=True).collect()
    want = sorted((len((t or "").encode()), len(counts.library.encode(t or ""))) for _, t in HARD)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 20) and r.fit_tokens <= 20 for r in got)
    assert token_counts(empty, path).count() == 0


def test_pfair():
    from gradus.llm.mixing import pfair

    rng = random.Random(7)
    for _ in range(60):
        weights = [rng.randint(1, 9) for _ in range(rng.randint(1, 8))]
        slots, total = pfair(weights), sum(weights)
        assert sorted(x for s in slots for x in s) == list(range(total))
        for w, own in zip(weights, slots, strict=True):
            for t in range(total + 1):
                assert abs(sum(x < t for x in own) - t * w / total) < 1


def test_mix(table, empty):
    from gradus.llm.mixing import mix

    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 40), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(200)]
    rows += [(None, None, "en", "a"), (5, "xx", "en", "a")]
    out = mix(table(rows), {"a": 3}, block_chars=50, carry=["text"]).collect()
    assert len(out) == len(rows)
    place = Counter()
    for i, text, _, source in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], len(r[1] or ""))):
        hit = [r for r in out if (r.doc_id, r.source, r.place) == (i, source, place[source]) and r.carried.text == text]
        assert hit and all(r.block == place[source] // 50 for r in hit)
        place[source] += len(text or "")
    assert all(r.release <= r.slot < r.deadline for r in out)
    assert len({(r.source, r.block) for r in out}) == len({r.slot for r in out})
    assert mix(empty).count() == 0


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(5)], strict=False))


def similar(rows):
    sets = [shingles(t) for _, t in rows]
    link = [[0] * len(rows) for _ in rows]
    for x, a in enumerate(sets):
        for y, b in enumerate(sets):
            link[x][y] = x != y and bool(a) and bool(b) and 100 * len(a & b) >= 90 * len(a | b)
    out = []
    for x, (i, _) in enumerate(rows):
        seen, todo = {x}, [x]
        while todo:
            todo += [y for y, on in enumerate(link[todo.pop()]) if on and y not in seen and not seen.add(y)]
        ids = [-(2**63) if rows[y][0] is None else rows[y][0] for y in seen]
        out.append((i or 0, len(sets[x]), sum(link[x]), max(min(ids), 0) if min(ids) > -(2**63) else 0))
    return sorted(out)


def near_copies():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for size in (6, 12, 30, 150, 400, 900):
        base = [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(size)]
        for copy in range(8):
            new = list(base)
            for _ in range(copy * size // 150 + (copy > 4)):
                new[rng.randrange(size)] = "edit" + str(rng.randint(0, 9))
            rows.append((rng.randint(0, 10**6) * 100 + len(rows), " ".join(new[: size - (copy == 7)])))
    return rows


@pytest.mark.parametrize("region", [32, 1])
def test_ngram_jaccard(table, region):
    from gradus.llm.ngram_jaccard import ngram_jaccard

    rows = near_copies() + (HARD if region == 32 else [])
    got = ngram_jaccard(table(rows), region=region).collect()
    assert sorted((r[0] or 0, r[1], r[2], r[3] or 0) for r in got) == similar(rows)


def test_ngram_jaccard_of_nothing(empty, table):
    from gradus.llm.ngram_jaccard import ngram_jaccard

    assert ngram_jaccard(empty).count() == 0
    assert [tuple(r) for r in ngram_jaccard(table([(1, None)])).collect()] == [(1, 0, 0, 1)]


def test_components(spark):
    from gradus.llm.common import components

    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (100, 102)]
    links = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(k, 0) for k in range(41)} | {(k, 100) for k in (100, 101, 102)}


def junk_and_prose(table, spark):
    rng = random.Random(10)
    words = ["the", "of", "and", "river", "stone", "walks", "slowly", "under", "Every", "light"]
    rows, labels = list(HARD), []
    for i in range(100, 260):
        good = i % 3 > 0
        own = [rng.choice(words) if good else rng.choice(words).upper() + "%%%" for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(own) + "."))
        labels.append((i, int(good), 0))
    return table(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(table, spark, empty):
    from gradus.llm.common import crc_mod
    from gradus.llm.quality import quality

    docs, labels = junk_and_prose(table, spark)
    got = quality(docs, labels, crc_mod(5) != 0).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert sum(right) >= 0.95 * len(right) > 10
    assert {r.score for r in quality(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality(empty, labels, F.lit(True)).count() == 0


def test_language_id(table, empty, hard):
    from gradus.llm.language_id import fit, language_id

    rng = random.Random(11)
    words = {"en": ["the", "stone", "walks", "light"], "de": ["der", "stein", "geht", "licht"], "fr": ["le", "pierre", "marche", "éclat"]}
    rows = [(i, " ".join(rng.choices(words[x], k=9)), x, "s") for i in range(90) for x in [rng.choice(list(words))]]
    rows += [(900, "steinlicht", None, "s"), (901, "12 34", "en", "s"), (902, None, "de", "s"), (None, "éclatpierre", None, "s")]
    docs = table(rows)
    got = language_id(docs, fit(docs, F.col("doc_id") % 2 == 0)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    found = {r.doc_id: r.lang_pred for r in got}
    assert all(found[i] == x for i, _, x, _ in rows[:90])
    assert (found[900], found[901], found[902], found[None]) == ("de", "und", "und", "fr")
    assert {r.lang_pred for r in language_id(hard, fit(empty, F.lit(True))).collect()} == {"und"}
    assert language_id(empty, fit(docs, F.lit(True))).count() == 0


def test_fingerprints(hard, empty, table):
    from gradus.llm.fingerprints import boundaries, containment, edit_likeness, edited, fingerprint

    rng = random.Random(12)
    rows = [(7 * i, " ".join(f"word{rng.randint(0, 999)}" for _ in range(rng.randint(0, 300)))) for i in range(40)]
    got = {r.doc_id: r for r in edit_likeness(table(rows)).collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = edited(text, after)
        assert len(changed) <= len(text) and got[i].edited_sha256 == sha(changed) and got[i].n_chars == len(text)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (fingerprint(text), fingerprint(changed))
        assert got[i].near_next == containment(fingerprint(text), fingerprint(after))
    long = rows[5][1] + " x " + " ".join(r[1] for r in rows[6:12])
    assert containment(fingerprint(long), fingerprint("Some new words. " + long)) > 0.9
    assert boundaries(b"a" * 10000)[-1] == 10000 and fingerprint("") == ""
    out = edit_likeness(hard).collect()
    assert len(out) == len(HARD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert edit_likeness(empty).count() == 0


def test_lm_scores(hard, empty, table):
    from gradus.llm.common import crc_mod
    from gradus.llm.pitman_yor import lm_scores

    learns = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(x for i, t in HARD if learns(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in HARD:
        own = tokens(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own)
        want.append((i or 0, len(own), sum(counts[x] > 0 for x in own), n, round(base, 6)))
    got = lm_scores(hard, crc_mod(7) != 2).collect()
    assert sorted((r[0] or 0, *r[1:4], round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.open_score <= r.score < 0 for r in got), got
    assert all(r.open_score < r.score == 0 for r in lm_scores(hard, F.lit(False)).collect())
    assert lm_scores(empty, F.lit(True)).count() == 0


def test_lm_is_a_distribution(table, spark):
    import numpy as np
    import pyarrow as pa

    from gradus.llm.pitman_yor import Spelling, spelled

    kinds, _ = spelled(pa.array([b"the", b"then", b"", b"other"], pa.binary()))
    own, counts = np.unique(kinds, return_counts=True)
    model = Spelling(own, counts, 1)
    for context in (0, 0x7468, 0x6162):
        assert abs(model.probability((context << 8) + np.arange(256)).sum() - 1) < 1e-9
    grown = [(i, "alpha beta gamma alpha") for i in range(30)]
    from gradus.llm.pitman_yor import lm_scores

    rows = {r.doc_id: r for r in lm_scores(table([*grown, (99, "alpha unseen")]), F.col("doc_id") < 50).collect()}
    assert rows[99].n_known == 2 and rows[99].score > rows[99].base_score


def test_lm_conditions_on_the_token_before(table, monkeypatch):
    from gradus.llm import pitman_yor

    fluent, shuffled = "the cat sat on the mat", "mat the on cat the sat"
    docs = table([*[(i, fluent + f" w{i}") for i in range(20)], (97, fluent), (98, shuffled), (99, fluent + " unseen")])
    scores = lambda docs: {r.doc_id: r for r in pitman_yor.lm_scores(docs, F.col("doc_id") < 50).collect()}
    rows = scores(docs)
    assert rows[97].base_score == pytest.approx(rows[98].base_score) and rows[97].score > rows[98].score + 3
    assert rows[99].open_score <= rows[99].score < rows[97].score
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 20)  # neither blocks nor partitions are part of the model
    again = scores(docs.repartition(7))
    assert all(again[i].score == pytest.approx(rows[i].score, abs=1e-4) for i in rows)


def test_lm_context_does_not_depend_on_size():
    import numpy as np
    import pyarrow as pa

    from gradus.llm import pitman_yor

    words = pa.array([b"the", b"then", b"other", b"brother", b"zebra"], pa.binary())
    own, counts = pitman_yor.kind_counts(words, np.full(len(words), 2))
    model = pitman_yor.Spelling(own, counts, 1)
    kinds, _ = pitman_yor.spelled(words)
    top = pitman_yor.CONTEXT + 1
    assert model.top == top and list(model.kinds[top]) == list(np.unique(kinds)) and model.customers[top].sum() == 2 * len(kinds)
    assert kinds.max() < 1 << 8 * top  # the bound of what is broadcast
    many = np.arange(3_000_001, dtype=np.int64)
    assert pitman_yor.Spelling(many, np.ones(len(many), np.int64), 1, sweeps=0).top == top


def test_lm_words_are_numbered_as_they_first_occur():
    import numpy as np

    from gradus.llm import pitman_yor

    rng, words, tokens = random.Random(9), pitman_yor.Words(), []
    for size in [0, 1, 0, 120_000, *rng.choices(range(3000), k=100)]:  # several arrays, and a document that fills one
        own = [b"%d" % rng.randint(0, 20_000) if rng.random() < 0.9 else "é\0".encode() for _ in range(size)]
        assert words.add(list(own)) == size + 1
        tokens += [*own, b""]
    known, numbers = words.numbered()
    assert known.to_pylist() == list(dict.fromkeys(tokens)) and numbers.dtype == np.int32
    assert [known[k].as_py() for k in numbers[:5000].tolist()] == tokens[:5000]
    place = {w: k for k, w in enumerate(known.to_pylist())}
    assert numbers.tolist() == [place[w] for w in tokens]


def test_seat_is_one_customer_after_the_other(monkeypatch):
    import numpy as np

    from gradus.llm import pitman_yor

    def one_by_one(customers, pull, d, key):
        tables = 1
        for seated in range(1, customers):
            u = pitman_yor.uniform(np.array([key], np.uint64), seated - 1)[0]
            tables += u < pull / (pull + max(seated - d * tables, 1e-9))
        return tables

    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    customers, pull = rng.integers(1, pitman_yor.EXACT, 300), rng.exponential(3, 300)
    got = pitman_yor.seat(customers, pull, 0.6, keys)
    assert got.tolist() == [one_by_one(int(c), p, 0.6, k) for c, p, k in zip(customers, pull, keys, strict=True)]
    assert pitman_yor.seat(np.array([0, 1]), np.ones(2), 0.6, keys[:2]).tolist() == [0, 1]
    # Groups against single customers: the mean and the spread of the tables.
    for weight, d in ((0.01, 0.7), (2.0, 0.5), (300.0, 0.3)):
        many = np.full(1500, 2000)
        own = rng.integers(1, 1 << 62, 1500).astype(np.uint64)
        grouped = pitman_yor.seat(many, np.full(1500, weight), d, own)
        monkeypatch.setattr(pitman_yor, "EXACT", 10**9)
        single = pitman_yor.seat(many, np.full(1500, weight), d, pitman_yor.mixed(own))
        monkeypatch.undo()
        spread = max(single.std(), 0.2)
        assert abs(grouped.mean() - single.mean()) < 0.15 * spread and abs(grouped.std() / spread - single.std() / spread) < 0.1


def test_binomial():
    import numpy as np

    from gradus.llm.pitman_yor import binomial

    keys = np.random.default_rng(4).integers(1, 1 << 62, 20000).astype(np.uint64)
    for n, p in ((6, 0.97), (40, 0.1), (2000, 0.01), (10**6, 1e-6), (500, 0.5), (10**9, 0.3)):
        got = binomial(np.full(len(keys), n), np.full(len(keys), p), keys, 2)
        sd = math.sqrt(n * p * (1 - p))
        assert 0 <= got.min() and got.max() <= n
        assert abs(got.mean() - n * p) < 0.04 * sd and abs(got.std() / sd - 1) < 0.04


def brute_lm(rows, learns, sweeps=2):
    """The model with dictionaries in one process; seats and spelling are the operator's own (tested above)."""
    import numpy as np
    import pyarrow as pa

    from gradus.llm import pitman_yor as P

    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    after = lambda own: list(zip(own[-1:] + own[:-1], own, strict=True))
    docs = [(i, tokens(t), learns(i)) for i, t in rows]
    pairs = Counter(x for _, own, on in docs if on for x in after(own))
    count = Counter(x for _, own, on in docs if on for x in own)
    words = sorted({x for _, own, _ in docs for x in own})
    hashes = dict(zip(words, P._hashes(words), strict=True))
    keys = [P.mixed(np.array([P.mixed(np.array([hashes[u]]))[0] + hashes[w] * np.uint64(0x9E3779B97F4A7C15)]))[0] for u, w in pairs]
    few = lambda c: P.discount(sum(x == 1 for x in c), sum(x == 2 for x in c))
    pair_d, seated, tables, past = few(pairs.values()), dict.fromkeys(pairs, 1), None, []
    for sweep in range(sweeps + 1):
        back, eaters = Counter(), Counter()
        for (u, w), t in seated.items():
            back[u] += t
            eaters[w] += t
        if sweep == 0:
            tables = {w: min(eaters[w], 1) for w in words}
        else:
            pull = (1 + d * sum(tables.values())) * np.exp(spelling.words(pa.array(words, pa.binary())))  # noqa: F821
            new = P.seat(np.array([eaters[w] for w in words]), pull, d, P.keyed(np.array([hashes[w] for w in words]), sweep))  # noqa: F821
            tables = dict(zip(words, new.tolist(), strict=True))
        d = few(eaters.values())
        spelt = [w for w in words if tables[w]]
        kinds = Counter()
        for w in spelt:
            for k in P.spelled(pa.array([w], pa.binary()))[0].tolist():
                kinds[k] += tables[w]
        spelling = P.Spelling(np.array(sorted(kinds), np.int64), np.array([kinds[k] for k in sorted(kinds)], np.int64), sweep)
        base = dict(zip(words, np.exp(spelling.words(pa.array(words, pa.binary()))), strict=True))
        weight = 1 + d * sum(tables.values())
        n = sum(eaters.values())
        chance = {w: (max(eaters[w] - d * tables[w], 0) + weight * base[w]) / (1 + n) for w in words}
        rest = weight * (1 - sum(base[w] for w in words if count[w])) / (1 + n)
        past.append((dict(seated), back, {w: chance[w] if count[w] else rest for w in words}))
        new = P.seat(np.array(list(pairs.values())), np.array([(1 + pair_d * back[u]) * np.float64(np.exp(np.float64(np.float32(np.log(chance[w]))))) for u, w in pairs]), pair_d, P.keyed(np.array(keys), sweep + 1))
        seated = dict(zip(pairs, new.tolist(), strict=True))

    def given(u, w):
        each = [(pairs[u, w] - pair_d * t.get((u, w), 0) + (1 + pair_d * back[u]) * p[w]) / (1 + count[u]) for t, back, p in past[1:]]
        return math.log10(sum(each) / len(each))

    return [(i or 0, sum(given(u, w) for u, w in after(own))) for i, own, _ in docs]


@pytest.mark.parametrize("tokens", [4_000_000, 30])
def test_lm_scores_are_the_model(table, monkeypatch, tokens):
    from gradus.llm import pitman_yor

    rng = random.Random(13)
    words = ["the", "of", "river", "stone", "walks", "slowly", "under", "light", "é", "X"]
    rows = [(i, " ".join(rng.choices(words, weights=range(10, 0, -1), k=rng.randint(0, 60)))) for i in range(60)]
    rows += [(i, "the river walks " * 80) for i in range(60, 64)] + [(None, "unseen words"), (64, None), (63, "the of")]
    learns = lambda i: i is not None and i % 5 != 0
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", tokens)
    got = pitman_yor.lm_scores(table(rows), F.col("doc_id") % 5 != 0).collect()
    want = sorted(brute_lm(rows, learns))
    for have, (i, score) in zip(sorted((r.doc_id or 0, r.score) for r in got), want, strict=True):
        assert have == (i, pytest.approx(score, abs=1e-3))


def brute_quality(text):
    """The statistics written out once more, character by character."""
    data = (text or "").encode()
    words, lines, n = data.split(), data.split(b"\n"), max(1, len(data))
    count = Counter(data)
    letters = [b for b in count if chr(b).isalpha() and b < 128 or b >= 128]
    blanks, plain = b" \t\n\r\x0b\x0c", b".,;:'\"-!?"
    share = lambda test: math.sqrt(sum(k for b, k in count.items() if test(b)) / n)
    mark = lambda b: not (48 <= b <= 57 or b in letters or b in blanks)
    many, longest = max(1, len(words)), max(lines.count(x) * len(x) for x in set(lines))
    return [
        math.log1p(len(data)), math.log1p(len(words)), math.log1p(sum(map(len, words)) / many), share(lambda b: 65 <= b <= 90),
        share(lambda b: 48 <= b <= 57), share(lambda b: mark(b) and b in plain), share(lambda b: mark(b) and b not in plain),
        share(lambda b: b >= 128), math.log1p(len(data) / len(lines)), math.sqrt(len(set(words)) / many), math.sqrt(len(set(lines)) / len(lines)),
        math.sqrt(longest / n), math.sqrt(sum(w.istitle() for w in words) / many), math.sqrt(sum(count[b] for b in b".!?") / many),
        -sum(k / n * math.log2(k / n) for k in count.values()),
    ]


def test_quality_is_the_discriminant(table, spark):
    import numpy as np

    from gradus.llm import quality as Q
    from gradus.llm.common import crc_mod

    docs, labels = junk_and_prose(table, spark)
    stats = {r.doc_id: r.stats for r in Q.document_statistics(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, own in stats.items():
        if i != 9:
            assert own == pytest.approx(brute_quality(texts[i]), abs=1e-9)
    train = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]

    def fitted(rows, shrink, ridge=0.05):
        x, y = np.array([stats[i] for i, _ in rows]), np.array([q for _, q in rows])
        cov = {k: np.cov(x[y == k].T, bias=True) for k in (0, 1)}
        pooled = sum((y == k).mean() * cov[k] for k in (0, 1))
        pooled = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))

        def score(i):
            logs = []
            for k in (0, 1):
                own = shrink + (1 - shrink) * len(pooled) / (len(pooled) + (y == k).sum())
                c, gap = (1 - own) * cov[k] + own * pooled, np.array(stats[i]) - x[y == k].mean(axis=0)
                logs.append(math.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * gap @ np.linalg.solve(c, gap))
            return 1 / (1 + math.exp(min(500, max(-500, logs[0] - logs[1]))))

        return score

    fold = lambda i: zlib.crc32(str(i).encode()) // 5 % Q.FOLDS
    losses = {}
    for shrink in Q.SHRINKS:
        own = 0.0
        for k in range(Q.FOLDS):
            score = fitted([r for r in train if fold(r[0]) != k], shrink)
            own -= sum(math.log(max(1e-12, score(i) if q else 1 - score(i))) for i, q in train if fold(i) == k)
        losses[shrink] = own
    score = fitted(train, min(losses, key=lambda x: (round(losses[x], 6), -x)))
    for r in Q.quality(docs, labels, crc_mod(5) != 0).collect():
        if r.doc_id != 9:
            assert r.score == pytest.approx(score(r.doc_id), abs=1e-6)


def brute_language(rows, learns, per_language=500):
    """Word-first backoff with dictionaries: {id: (language, score)}; the sample holds all rows."""
    words_of = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    langs = sorted({x for i, _, x in rows if learns(i) and x is not None})
    count = {x: Counter(w for i, t, y in rows if learns(i) and y == x for w in words_of(t)) for x in langs}
    docs = {x: sum(learns(i) and y == x for i, _, y in rows) for x in langs}

    def pieces(word, n):
        full = f"^{word}$" if n > 1 else word
        return [full[k : k + n] for k in range(len(full) - n + 1)]

    tables = [count] + [{x: Counter({}) for x in langs} for _ in range(5)]
    for n in range(1, 6):
        for x in langs:
            for w, k in count[x].items():
                for g in pieces(w, n):
                    tables[n][x][g] += k
    known = [set().union(*t.values()) if langs else set() for t in tables]

    def chance(table, key):
        return [math.log((tables[table][x][key] + 0.5) / (sum(tables[table][x].values()) + 0.5 * len(known[table]))) for x in langs]

    def one(word):
        if word in known[0]:
            return chance(0, word)
        for n in range(5, 0, -1):
            if found := [chance(n, g) for g in pieces(word, n) if g in known[n]]:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    def predict(text):
        if not langs or not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        total = [math.log(docs[x] / sum(docs.values())) for x in langs]
        for w in words_of(text):
            total = [a + b for a, b in zip(total, one(w), strict=True)]
        best = max(range(len(langs)), key=lambda k: total[k])
        return langs[best], 1 / sum(math.exp(x - total[best]) for x in total)

    return predict


def test_language_id_is_word_first(table, monkeypatch):
    from hard_rows import LONG

    from gradus.llm.language_id import fit, language_id

    rng = random.Random(21)
    words = {"en": ["the", "stone", "walks", "light"], "de": ["der", "stein", "geht", "licht"], "fr": ["le", "pierre", "marche", "éclat"]}
    rows = [(i, " ".join(rng.choices(words[x], k=rng.randint(1, 9))), x, "s") for i in range(80) for x in [rng.choice(list(words))]]
    rows += [(200, "steinlicht pierr Unbekannt the", None, "s"), (201, LONG, "en", "s"), (202, "xyz", None, "s"), (203, "", "de", "s")]
    learns = lambda i: i is not None and i % 3 != 1
    predict = brute_language([(r[0], r[1], r[2]) for r in rows], learns)
    docs = table(rows)
    for r in language_id(docs, fit(docs, F.col("doc_id") % 3 != 1), carry=["text", "source"]).collect():
        lang, score = predict(r.text)
        assert (r.lang_pred, r.score, r.source) == (lang, pytest.approx(score, abs=1e-9), "s")


def test_language_sample_is_bounded_and_repeatable(table):
    from gradus.llm.language_id import fit

    rows = [(i, f"word{chr(97 + i % 26)} common", "en", "s") for i in range(300)]
    few = lambda docs: fit(docs, F.lit(True), per_language=10)
    one, other = few(table(rows)), few(table(rows[::-1]).repartition(5))
    assert one.words == other.words and 1 < len(one.words) <= 11
    same = table([(7, "one text", "en", "s")] * 500 + [(8, "another text", "en", "s")])
    assert set(few(same).words) == {"one", "another", "text"}  # repeated rows count once, and hide no others


def test_fingerprints_are_the_chunks(table):
    import base64

    import xxhash

    from gradus.llm import fingerprints as P

    def chunks(text):
        data, ends, begin = re.sub(rb"[\x20\x09-\x0D]+", b" ", text.encode().lower()).strip(), [], 0
        for k in range(1, len(data)):
            own = data[max(0, k - P.WINDOW) : k]
            h = sum(int(P._GEAR[b]) << (len(own) - 1 - j) for j, b in enumerate(own)) & 0xFFFFFFFF
            if h >> 32 - P.BITS == 0 or k - begin == P.MOST:
                ends.append(k)
                begin = k
        ends += [len(data)] * bool(data)
        return {xxhash.xxh32_intdigest(data[a:b]): b - a for a, b in zip([0, *ends], ends, strict=False)}

    def text_of(found):
        return base64.b64encode(b"".join(k.to_bytes(4, "little") + v.to_bytes(2, "little") for k, v in sorted(found.items()))).decode()

    def near(a, b):
        return 1.0 if a == b else sum(n for k, n in a.items() if k in b) / sum(a.values()) if a else 0.0

    rng = random.Random(22)
    rows = [(5 * i, " ".join(f"Word{rng.randint(0, 99)}é" for _ in range(rng.randint(0, 200)))) for i in range(30)]
    rows += [(1000, None), (1001, rows[3][1] + " and more"), (1002, rows[3][1]), (1003, "")]
    got = {r.doc_id: r for r in P.edit_likeness(table(rows)).collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, other, following = chunks(text), chunks(changed), chunks(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(changed), text_of(own), text_of(other))
        assert (r.near_edited, r.near_next) == (pytest.approx(near(own, other)), pytest.approx(near(own, following)))


def test_place_among(spark):
    from gradus.llm.common import place_among

    for cuts in ([], [5], [1, 5, 9], list(range(0, 700, 7))):
        got = spark.range(-3, 720).select("id", place_among(cuts, F.col("id")).alias("at")).collect()
        assert all(r["at"] == sum(c <= r.id for c in cuts) for r in got)


def test_mix_of_long_texts_and_too_many_sources(table):
    from hard_rows import LONG

    from gradus.llm.mixing import mix

    out = mix(table([(1, LONG, "en", "a"), (2, "x", "en", "a"), (3, "y", "en", "b")]), block_chars=50).collect()
    assert {r.doc_id: (r.source, r.place, r.block) for r in out} == {1: ("a", 0, 0), 2: ("a", len(LONG), len(LONG) // 50), 3: ("b", 0, 0)}
    with pytest.raises(ValueError):
        mix(table([(1, "x", "en", "a"), (2, "y", "en", "b")]), max_slots=1)


def test_bpe_decode_of_odd_ids(spark, bpe):
    import public_tokenizers

    from gradus.llm.byte_bpe import bpe_decode

    at = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    half = bpe[0].encode("é").tolist()[:1] if len(bpe[0].encode("é")) > 1 else bpe[0].encode("😀").tolist()[:1]
    rows = spark.createDataFrame([(1, None), (2, []), (3, half), (4, bpe[0].encode("ok").tolist()), (4, None)], "doc_id long, ids array<int>")
    got = sorted((r.doc_id, r.text) for r in bpe_decode(rows, *at).collect())
    assert got == [(1, ""), (2, ""), (3, "\ufffd"), (4, ""), (4, "ok")]
    assert bpe_decode(rows.limit(0), *at).count() == 0


def test_one_row_of_each_component_is_kept(table):
    from gradus.llm.ngram_jaccard import ngram_jaccard

    text = "some words that are the same in all of these"
    rows = [(None, text), (5, text), (5, text), (6, text), (9, None), (9, None), (3, "another text of only a few words"), (4, text + " x")]
    out = ngram_jaccard(table(rows), percent=70, decide=True).collect()
    assert Counter((r.component_id, r.n_shingles > 0) for r in out if r.kept) == {(None, True): 1, (3, True): 1, (9, False): 2}


def brute_pipeline(rows, library):
    """The stages over lists of (id, text, lang, source): what each gives, in order."""
    from corpus_pipeline import WEIGHTS

    key = lambda i: -(2**63) if i is None else i
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 1
    predict = brute_language([(i, t, x) for i, t, x, _ in rows], crc)
    docs = [(i, t, *predict(t), source) for i, t, _, source in rows]
    docs = [(i, t, lang, source) for i, t, lang, score, source in docs if lang != "und" and score >= 0.5]
    yield docs
    first = {}
    for i, t, *_ in docs:
        for line in t.split("\n"):
            k = lower(line.strip(SPACE))
            first[k] = min(first.get(k, key(i)), key(i))
    stays = lambda line, i: len(lower(line.strip(SPACE))) < 10 or first[lower(line.strip(SPACE))] == key(i)
    docs = [(i, "\n".join(x for x in t.split("\n") if stays(x, i)), *rest) for i, t, *rest in docs]
    yield docs
    sets, group = [shingles(r[1]) for r in docs], list(range(len(docs)))
    for x in range(len(docs)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y]):
                a, b = group[x], group[y]
                group = [b if g == a else g for g in group]
    best = {}
    for x, g in enumerate(group):
        if g not in best or key(docs[x][0]) < key(docs[best[g]][0]):
            best[g] = x
    docs = [r for x, r in enumerate(docs) if best[group[x]] == x]
    yield docs
    from gradus.llm.mixing import pfair

    sources = sorted({r[3] for r in docs})
    units = [WEIGHTS.get(x, 1) for x in sources]
    slots, placed = dict(zip(sources, pfair(units), strict=True)), []
    for source, unit in zip(sources, units, strict=True):
        place = 0
        for r in sorted((r for r in docs if r[3] == source), key=lambda r: (key(r[0]), len(r[1]))):
            block = place // (1 << 16)
            placed.append((block // unit * sum(units) + slots[source][block % unit], place, r))
            place += len(r[1])
    docs = [r for _, _, r in sorted(placed, key=lambda x: x[:2])]
    yield docs
    yield [(i, len(ids := library.encode_ordinary(t)), ids) for i, t, *_ in docs]


def pipeline_rows():
    rng = random.Random(23)
    words = {"en": ["the", "stone", "walks", "light", "under"], "de": ["der", "stein", "geht", "licht", "unter"]}
    rows = []
    for i in range(40):
        lang = rng.choice(["en", "de"])
        rows.append((100 + i, "\n".join(" ".join(rng.choices(words[lang], k=rng.randint(3, 12))) for _ in range(rng.randint(1, 4))), lang, f"src{i % 4}"))
    text = " ".join(rng.choices(words["en"], k=80))
    rows += [(9, text, "en", "src0"), (9, text, "en", "src0"), (12, text, "en", "src1"), (None, text, "en", "src1")]
    rows += [(20, text + " and", "en", "src2"), (21, "the stone\nwalks " * 40, "en", "src3"), (9, "der stein geht unter licht heute", "de", "src0")]
    return rows + [(1, None, "en", "src0"), (2, "", "de", "src0"), (3, "12 34", None, "src1"), (None, "der geht", None, "src2")]


def test_pipeline_is_the_brute_force(spark, tmp_path, table, bpe):
    import corpus_pipeline

    rows = pipeline_rows()
    docs = table(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    flat = lambda rows: sorted((-1 if r[0] is None else r[0], *map(str, r[1:])) for r in rows)
    at = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_pipeline(rows, bpe[1]), strict=True):
        before, at = at, stage(spark, at, str(tmp_path))
        if name == "byte_bpe":
            got = [(r.doc_id, r.n_tokens, r.ids) for r in at.collect()]
        else:
            assert at.columns == docs.columns
            got = [(r.doc_id, r.text, r.lang, r.source) for r in at.collect()]
            assert all(r.n_chars == len(r.text) for r in at.collect() if name != "language_id")
        if name == "near_duplicates":  # of rows that repeat an identifier and text any may stay
            assert flat(r[:2] for r in got) == flat(r[:2] for r in want)
        else:
            assert flat(got) == flat(want), name
        if name == "mix_sources":
            assert [r[0] for r in got] == [r[0] for r in want]
        if name != "byte_bpe":
            at.write.parquet(f"{tmp_path}/{name}")
            at = spark.read.schema(at.schema).parquet(*sorted(map(str, (tmp_path / name).glob("*.parquet"))))
    assert flat((r.doc_id, r.n_tokens, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == flat(want)


def test_pipeline(spark, tmp_path, table):
    import corpus_pipeline

    rows = [(i, t, "en", f"s{(i or 0) % 2}") for i, t in near_copies()[24:40] + HARD]
    docs = table(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    gone = {3, 4, 5}
    assert not gone & {r.doc_id for r in out} and len(out) > 10
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
