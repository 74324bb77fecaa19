"""Document operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from knownat.llm import bpe, ctw, encode, exact, nearcopies, packing, quality, tokens, toxicity
from knownat.llm.common import bounded_sample, keep_predicted
from knownat.llm.queries import BYTE_BPE, MULTI_RANKS

random.seed(5)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "rho", "été", "ñu", "the", "of", "x9", "--", "it's"]


def sentence(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


LONG = sentence(30_000)
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a  b\n\n c.\nD, e's"), (7, "a b c.\nD, e's"), (8, LONG),
    (9, LONG + " end"), (9, LONG + " end"), (10, "x" * 5000), (None, "one"), (None, None), (11, "  　y \x1c z"),
    (12, "naïve café\r\nʼtis 日本語のテキスト 🙂🙂"), (13, "<|endoftext|> said"),
]


@pytest.fixture(scope="module")
def odd(tiny):
    return tiny(ODD).repartition(3).persist()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@lru_cache
def tokenizer(path):
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return own


def ids_of(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_whole_texts():
    own = encode.Encoder(BYTE_BPE, kept=4)
    pieces = ["a", "Bc", " ", "  ", "\n", ".", ",", "\t", "é", "'s", "1", " ", "\r\n", "--", "the", "\u0085", "²"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 30))) for _ in range(3000)] + [t for _, t in ODD]
    found = [b for k in range(0, len(texts), 50) for b in own.encode_all(texts[k:k + 50])]
    assert [array("I", b).tolist() for b in found] == [ids_of(BYTE_BPE, t) for t in texts]


def test_encoder_hands_fresh_chunks_on_together():
    own, handed = encode.Encoder(BYTE_BPE), []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    own.tokenizer, own.words = Counting(own.tokenizer), Counting(own.words)
    texts = [" ".join(f"w{k}x{n}&&\nend{k}é, {k}" for n in range(40)) for k in range(50)] + ["a  b\n c"]
    found = own.encode_all(pa.array(texts))
    assert [array("I", b).tolist() for b in found] == [ids_of(BYTE_BPE, t) for t in texts]
    assert len(handed) < 4 * len(texts)


def test_gathered_batches_keep_rows_and_order():
    texts = [None if n % 7 == 0 else "t" * (n % 50) for n in range(1000)]
    column = pa.record_batch({"doc_id": pa.array(range(1000)), "text": pa.array(texts)})
    batches = list(encode.gathered((column.slice(a, 30) for a in range(0, 1000, 30)), least=2000))
    assert 1 < len(batches) < 34
    assert pa.Table.from_batches(batches).equals(pa.Table.from_batches([column]))


def test_token_table(odd):
    found = sorted(tokens.token_table(odd, BYTE_BPE, 2).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    wanted = {}
    for i, text in ODD:
        wanted.setdefault(i, []).append(np.array(ids_of(BYTE_BPE, text) + [2], "<u4"))
    start = 0
    for row in found:
        assert row["start"] == start
        assert any(len(w) == row["n_tokens"] and zlib.crc32(w.tobytes()) == row["ids_crc32"] for w in wanted[row["doc_id"]])
        start += row["n_tokens"]


def test_token_files_are_read_in_part(spark, odd, tmp_path):
    tokens.write_tokens(odd, str(tmp_path / "t"), BYTE_BPE)
    some = tokens.read_tokens(spark, str(tmp_path / "t"), [4, 10])
    assert {r["doc_id"]: r["ids"][-1] for r in some.collect()} == {4: 2, 10: 2}
    plan = tokens.read_metadata(spark, str(tmp_path / "t"))._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan


def test_token_table_of_nothing(tiny):
    assert tokens.token_table(tiny([]), BYTE_BPE).count() == 0


def test_rank_file_bpe(odd):
    found = sorted(map(str, rows_of(bpe.encode_documents(odd, MULTI_RANKS, public_tokenizers.PATTERN))))
    own = bpe.encoding(MULTI_RANKS, public_tokenizers.PATTERN)
    wanted = []
    for i, text in ODD:
        ids = own.encode_ordinary(text or "")
        wanted.append(str((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
                           hashlib.sha256((text or "").encode()).hexdigest(), ids)))
    assert found == sorted(wanted)


def test_parts_cut_where_matches_end():
    text = LONG[:20_000] + "\n\n  " + "y" * 3000 + " z"
    own = bpe.encoding(MULTI_RANKS, public_tokenizers.PATTERN)
    cut = list(bpe.parts(text, 500))
    assert len(cut) > 10 and "".join(cut) == text
    assert [i for p in cut for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


def test_separators_are_no_white_space_to_the_pattern():
    text = "".join(random.choice(["ab", "7", "!", " ", "\n", "\x1c", "\x1d\x1e", "\x85", "\u3000", "\x1f"]) for _ in range(6000))
    own = bpe.encoding(MULTI_RANKS, public_tokenizers.PATTERN)
    cut = list(bpe.parts(text, 40))
    assert len(cut) > 50 and "".join(cut) == text and not any(p[0] in "\x1c\x1d\x1e\x1f" for p in cut)
    assert [i for p in cut for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


def test_exact_duplicates(odd):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, text in ODD:
        groups.setdefault(normal(text), []).append(i)
    found = exact.exact_duplicates(odd, width=2).collect()
    assert len(found) == len(ODD)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for row in found:
        ids = by_sha[row["text_sha256"]]
        assert row["group_size"] == len(ids) and row["keep_id"] == min((i for i in ids if i is not None), default=None)
    assert Counter(r["text_sha256"] for r in found if r["kept"]) == Counter(list(by_sha))
    stay = exact.keep_one(odd)
    assert stay.columns == odd.columns and stay.count() == len(groups)
    clashing = odd.selectExpr("*", "fingerprint AS _key", "lang AS _sha", "lang AS _text")
    stay = exact.keep_one(clashing)
    assert stay.columns == clashing.columns and {(r["_key"], r["_sha"]) for r in stay.collect()} == {(1, "en")}
    wanted = {(min((i for i in ids if i is not None), default=None), text) for text, ids in groups.items()}
    assert {(r["doc_id"], normal(r["text"])) for r in stay.collect()} == wanted


def test_filters_pile_up_in_doubling_sizes():
    prints = np.random.default_rng(4).integers(0, 5000, 20_000).astype(np.uint64) << np.uint64(40)
    pile, merged = [], 0
    for batch in np.split(prints, 200):
        sizes = sum(len(f.counts) for f in pile)
        exact.add_filter(pile, exact.CountingQuotientFilter.build(batch, 12))
        merged += sizes != sum(len(f.counts) for f in pile[:-1])
        assert all(len(a.counts) > 2 * len(b.counts) for a, b in zip(pile, pile[1:]))
    assert merged and len(pile) <= 13
    while len(pile) > 1:
        pile.append(pile.pop().merge(pile.pop()))
    keys, counts = np.unique(prints, return_counts=True)
    assert (pile[0].fingerprints() == keys).all() and (pile[0].counts == counts).all()


def test_exact_duplicates_of_nothing(tiny):
    assert exact.exact_duplicates(tiny([])).count() == 0


def test_quotient_filters_merge_without_loss():
    random_ = np.random.default_rng(3)
    for bits in (1, 5, 20):
        a, b = (random_.integers(0, 1 << 64, 3000, np.uint64)[random_.integers(0, 300, 5000)] for _ in range(2))
        left, right = (exact.CountingQuotientFilter.build(x, bits) for x in (a, np.concatenate([b, a[:50]])))
        whole = left.merge(right)
        keys, counts = np.unique(np.concatenate([a, b, a[:50]]), return_counts=True)
        assert (whole.fingerprints() == keys).all() and (whole.counts == counts).all()
        again = exact.CountingQuotientFilter.from_bytes(bits, whole.to_bytes())
        assert (again.fingerprints() == keys).all()
        cut = list(whole.slices(min(bits, 3)))
        assert sum(int(part.counts.sum()) for _, part in cut) == counts.sum()


def near_rows():
    base = [sentence(60).split() for _ in range(12)]
    rows, i = [], 100
    for words in base:
        for _ in range(6):
            own = list(words)
            for _ in range(random.randint(0, 4)):
                own[random.randrange(len(own))] = f"w{random.randrange(9)}"
            rows.append((i, random.choice([" ", "\n"]).join(own)))
            i += 1
    return rows + [(7, "two words"), (8, "Two  WORDS"), (9, None), (10, " "), (11, ""), (12, "one"), (13, "ONE")]


def test_near_duplicates_against_all_pairs(tiny):
    rows = near_rows()
    component, sizes = brute.near_components(rows)
    found = nearcopies.near_duplicates(tiny(rows).repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == {
        i: (sizes[i], component[i], component[i] == i) for i, _ in rows}


def test_large_bands_are_compared_in_blocks(spark):
    texts = [(i, t) for i, t in near_rows() if len((t or "").split()) > 5]
    own = nearcopies.Shingler()
    rows = []
    for i, t in texts:
        found = own.shingles(t.encode().lower())
        rows.append((1, i, i, 1, len(found), bytearray(nearcopies.sketch(found).tobytes()), len(texts)))
    members = spark.createDataFrame(rows, "band long, rep long, comp long, of long, n long, sketch binary, size long")
    few, many = (set(map(tuple, nearcopies.across(members, 75, block).collect())) for block in (4096, 7))
    assert few == many and few


def test_documents_meet_components_in_packs(spark, tiny):
    rows = [(i, t) for i, t in near_rows() if len((t or "").split()) > 5]
    component, _ = brute.near_components(rows)
    docs = tiny(rows)
    split = {i: (100 if i % 2 else 101) for i, _ in rows}
    places = spark.createDataFrame([(i, split[i], 36) for i, _ in rows], "rep long, comp long, of long")
    named = spark.createDataFrame([(i, 201 - split[i]) for i, _ in rows], "x long, comp long")
    sets = {i: brute.shingles(t) for i, t in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    found = [tuple(r) for r in nearcopies.meetings(named, places, docs, 75, pack=5, together=4).collect()]
    assert all(split[a] != split[b] and near(a, b) for a, b in found)
    assert {a for a, _ in found} == {a for a in sets if any(split[a] != split[b] and near(a, b) for b in sets)}


def test_near_duplicates_odd_rows(odd):
    found = nearcopies.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[5]["component_id"] == 4 and not by_id[5]["kept"] and by_id[9]["component_id"] == 8
    assert by_id[1]["n_shingles"] == 0 and by_id[1]["kept"] and by_id[2]["component_id"] == 2
    assert by_id[None]["component_id"] is None and not by_id[None]["kept"]


def test_near_duplicates_of_nothing(tiny):
    assert nearcopies.near_duplicates(tiny([])).count() == 0
    assert nearcopies.keep_one(tiny([(None, "a"), (1, "b")])).count() == 2


def test_sketches_estimate_similarity():
    random_ = np.random.default_rng(8)
    for size, shared in ((40, 30), (1000, 800)):
        whole = random_.integers(0, 1 << 63, 2 * size, np.uint64)
        a, b = whole[:size], whole[size - shared:2 * size - shared]
        agree = (nearcopies.sketch(a) == nearcopies.sketch(b)).mean()
        assert abs(agree - shared / (2 * size - shared)) < 0.17
    assert len(nearcopies.sketch(np.array([5], np.uint64))) == nearcopies.BINS


def test_packing(odd):
    capacity = 64
    found = packing.pack(odd, BYTE_BPE, capacity, end_id=0).collect()
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text in ODD:
        if i is None or i == 9:
            continue
        ids = np.array(ids_of(BYTE_BPE, text) + [0], "<u4")
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == packing.cut(len(ids), capacity)
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in own]
    assert_gapless(found, capacity)


def assert_gapless(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        end = 0
        for offset, length in places:
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_filters_merge_in_order_and_pack_remainders(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (3000, 500))
    left, right = (exact.CountingQuotientFilter.build(x, 24) for x in (np.concatenate([a, a[:9]]), np.concatenate([b, a[:200], a[-1:]])))
    wanted = Counter(np.concatenate([a, a[:9], b, a[:200], a[-1:]]).tolist())
    # Merging is not counting anew.
    monkeypatch.setattr(exact.CountingQuotientFilter, "build", None)
    none = exact.CountingQuotientFilter._runs(a[:0], np.zeros(0, np.int64), 24)
    for whole in (left.merge(right), right.merge(left), none.merge(left).merge(none).merge(right)):
        assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist())) == wanted
        assert (np.diff(whole.fingerprints()) > 0).all() and len(whole.to_bytes()[2]) == 5 * len(whole.counts)
        again = exact.CountingQuotientFilter.from_bytes(24, whole.to_bytes())
        assert (again.fingerprints() == whole.fingerprints()).all() and (again.counts == whole.counts).all()


def test_packing_of_nothing(tiny):
    assert packing.pack(tiny([]), BYTE_BPE).count() == 0


def optimum(lengths, capacity):
    """Fewest bins by search, for a handful of pieces."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= capacity and bins[b] not in bins[:b]:
                place(k + 1, bins[:b] + [bins[b] + lengths[k]] + bins[b + 1:])
        place(k + 1, bins + [lengths[k]])

    place(0, [])
    return best[0]


def test_dominating_sets_keep_the_optimum():
    random_ = random.Random(2)
    for _ in range(300):
        capacity = random_.choice([10, 17, 30])
        lengths = [random_.randint(1, capacity) for _ in range(random_.randint(1, 9))]
        stock = packing.Stock(np.bincount(lengths, minlength=capacity + 1))
        fixed = packing.reduce_instance(stock, capacity)
        left = [v for v, n in stock.counts.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + optimum(left, capacity) == optimum(lengths, capacity)
        groups = packing.solve(np.bincount(lengths, minlength=capacity + 1), capacity)
        held = Counter(v for pattern, n in groups for v in pattern * n)
        assert held == Counter(lengths) and all(sum(p) <= capacity for p, _ in groups)


def test_context_trees_by_hand():
    texts, training = [b"abracadabra", b"abba", b"zz\xc3\xa9"], np.array([True, True, False])
    keys, counts = ctw.block_entries(pa.chunked_array([texts], pa.binary()), training)[0][1:]
    below, seen, top = ctw.subtree(keys, counts)
    upper = (((top.keys >> np.uint64(8)) & np.uint64(0xFF)) << np.uint64(8)) | (top.keys & np.uint64(0xFF))
    distinct, place = np.unique(upper, return_inverse=True)
    tree = ctw.Top.build(distinct, *(np.bincount(place, v) for v in (top.zeros, top.ones, top.log_weighted)))
    values = dict(zip(keys.tolist(), tree.log10(keys, below, seen).tolist()))
    wanted = PlainTree(texts[:2])
    for text in texts:
        own, _ = ctw.grams([text])
        assert sum(values[k] for k in own.tolist()) == pytest.approx(wanted.log10(text), rel=1e-9)


class PlainTree:
    """The same model, node by node."""

    def __init__(self, texts):
        self.counts = {}
        self.kids = {}
        for text in texts:
            for context, byte in self.places(text):
                for depth in range(ctw.DEPTH + 1):
                    for node, bit in self.decisions(byte):
                        key = (context[len(context) - depth:], node)
                        self.counts.setdefault(key, [0, 0])[bit] += 1
                        if depth:
                            self.kids.setdefault((key[0][1:], node), set()).add(key)
        self.memo = {}

    @staticmethod
    def places(text):
        edge = bytes([ctw.EDGE])
        whole = edge * ctw.DEPTH + text + edge
        return [(whole[k - ctw.DEPTH:k], whole[k]) for k in range(ctw.DEPTH, len(whole))]

    @staticmethod
    def decisions(byte):
        return [((1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1) for j in range(8)]

    def kt(self, key):
        zeros, ones = self.counts[key]
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def weighted(self, key):
        if key not in self.memo:
            own = self.kt(key)
            if len(key[0]) < ctw.DEPTH:
                below = sum(self.weighted(k) for k in self.kids[key])
                high = max(own, below)
                own = high + math.log(0.5 * math.exp(own - high) + 0.5 * math.exp(below - high))
            self.memo[key] = own
        return self.memo[key]

    def one(self, context, node, depth=0):
        key = (context[len(context) - depth:], node)
        if key not in self.counts:
            return 0.5 if depth == 0 else None
        zeros, ones = self.counts[key]
        own = (ones + 0.5) / (zeros + ones + 1)
        below = self.one(context, node, depth + 1) if depth < ctw.DEPTH else None
        if below is None:
            return own
        stop = math.exp(math.log(0.5) + self.kt(key) - self.weighted(key))
        return stop * own + (1 - stop) * below

    def log10(self, text):
        total = 0.0
        for context, byte in self.places(text):
            for node, bit in self.decisions(byte):
                p = self.one(context, node)
                total += math.log10(p if bit else 1 - p)
        return total


def test_scores_of_whole_texts(odd):
    found = ctw.score(odd).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in ODD}
    counts = Counter(w for i, t in ODD if not held[i] for w in brute.words(t) + [None])
    n, v = sum(counts.values()), len(counts)
    base = Counter()
    for i, text in ODD:
        words = brute.words(text) + [None]
        base[i, held[i], len(words), sum(w in counts for w in words), n,
             round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))
                   for r in found) == base
    assert all(r["score"] < 0 for r in found)


def test_scores_use_the_seventh_byte_before(tiny):
    same = [(i, text) for i in range(40) for text in ("xabcdefp", "yabcdefq")]
    found = {r["doc_id"]: r["score"] for r in ctw.score(tiny(same + [(1001, "xabcdefp"), (1002, "xabcdefq")])).collect()}
    # Only x or y, seven bytes before p or q, tells which of the two it is.
    assert found[1001] > found[1002] + 1


def test_no_id_owns_a_block_of_trees(tiny, monkeypatch):
    texts = ["".join(random.Random(k).choices("abcde ", k=150)) for k in range(80)]
    rows = [(None if k % 2 else 7, text) for k, text in enumerate(texts)] + [(8, "one text " * 20), (9, "and one " * 20)] * 40
    docs = tiny(rows)

    def scores():
        return Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                        round(r["base_score"], 6), round(r["score"], 6)) for r in ctw.score(docs).collect())

    one_block, read, held = scores(), ctw.read_blocks, []
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(ctw, "read_blocks", lambda dealt: held.append(dealt) or read(dealt))
    assert scores() == one_block and sum(one_block.values()) == len(rows)
    largest = Counter()
    for r in held[0].select("block", "text").collect():
        largest[r["block"]] += len(r["text"])
    assert len(largest) > 5 and max(largest.values()) < 2 * 3000


def test_scores_of_nothing(tiny):
    assert ctw.score(tiny([])).count() == 0


def junk(rows):
    return [(i, " | ".join(t.split())) for i, t in rows]


def test_quality_learns_and_scores_all_rows(spark, tiny, odd):
    good = [(i, sentence(80)) for i in range(0, 300, 2)]
    bad = junk([(i, sentence(80)) for i in range(1, 300, 2)])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 1), (5, None, None)],
                                   "doc_id long, quality int, toxic int")
    docs = tiny(good + bad)
    network = quality.fit(docs, labels)
    found = quality.score(docs, network).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == 1 - r["doc_id"] % 2 for r in held) >= 0.95 * len(held)
    scored = quality.score(odd, network).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.judged(odd, network).columns[:-2] == [c for c in odd.columns if c != "_score"]
    empty = quality.fit(tiny([]), labels)
    assert [r["predicted"] for r in quality.score(tiny([(1, None)]), empty).collect()] == [1]
    assert quality.score(tiny([]), network).count() == 0


def test_pooling_in_blocks_equals_one_pass(monkeypatch):
    network = quality.Network.fresh()
    texts = [LONG[:7000].encode(), b"", b"ab", LONG[:600].encode()]
    whole = quality.features(network, texts)
    monkeypatch.setattr(quality, "BLOCK", 512)
    assert np.allclose(whole, quality.features(network, texts))
    assert np.allclose(whole, np.concatenate([quality.features(network, [t]) for t in texts]), atol=1e-5)


def test_gradients_are_slopes():
    network = quality.Network.fresh(4)
    texts, labels = [LONG[:900].encode(), b"A!! B!! " * 40], np.array([1.0, 0.0])
    found = quality.gradients(network, texts, labels)

    def loss():
        p = quality.predict(network, texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for weights, slope in ((network.dense, found[2]), (network.bias, found[1])):
        k = int(np.abs(slope).argmax())
        weights[k] += 1e-2
        up = loss()
        weights[k] -= 2e-2
        down = loss()
        weights[k] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(slope[k], rel=0.1)


def test_sample_keeps_its_bound_under_a_repeated_id(spark, tiny):
    rows = [(7, f"{k} " + sentence(100)) for k in range(600)] + [(7, None)] * 2 + [(i, sentence(20)) for i in range(100, 1300)]
    rows += [(None, "no id"), (5000, "z" * 2000)]
    labels = spark.createDataFrame([(i, float(i % 2)) for i in [7, 5000, *range(100, 1300)]], "doc_id long, _label double")
    for bound, places in ((8000, 400), (1 << 20, 40), (1 << 20, 4000), (10, 4000)):
        found = bounded_sample(tiny(rows), labels, places, bound)
        assert sum(len(text) for text, _ in found) <= bound and len(found) <= places
        assert found == bounded_sample(tiny(rows[::-1]).repartition(3), labels, places, bound)
    whole = bounded_sample(tiny(rows), labels, 4000, 1 << 20)
    assert len(whole) == 1202 and "" in [text for text, _ in whole]
    texts = {text: i for i, text in rows if i != 7}
    assert all(label == texts[text] % 2 for text, label in whole if text)
    assert bounded_sample(tiny([]), labels, 4000, 1 << 20) == []


def test_third_of_rows_under_one_id_leaves_both_models_sound(spark, tiny):
    good = [(i, sentence(80)) for i in range(2, 302)]
    rude = [" ".join(random.sample(sentence(80).split() + ["oaf", "lout", "oaf"], 83)) for _ in range(300)]
    bad = junk(zip(range(1002, 1302), rude))
    crowd = [(1, sentence(80)) for _ in range(300)]
    docs = tiny(good + bad + crowd)
    labels = spark.createDataFrame([(i, int(i < 1000), int(i >= 1000)) for i, _ in good + bad] + [(1, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    for model in (quality, toxicity):
        held = [r for r in model.score(docs, model.fit(docs, labels)).collect() if r["held_out"] and r["doc_id"] != 1]
        right = [r["predicted"] == ((r["doc_id"] >= 1000) if model is toxicity else (r["doc_id"] < 1000)) for r in held]
        assert len(held) > 100 and sum(right) >= 0.95 * len(right)


def test_kept_rows_keep_columns_named_like_the_judges_own(tiny, odd):
    found = toxicity.fit(tiny([]), odd.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int"))
    kept = keep_predicted(odd.withColumnRenamed("score", "_Predicted"), lambda d: toxicity.judged(d, found), 0)
    assert kept.count() == len(ODD) and {(r["_score"], r["_Predicted"]) for r in kept.collect()} == {(4.0, 2.0)}


def test_grammar_scores_clauses():
    found = toxicity.Grammar({"fool": 1.0}, {"blockh": 1.0})
    plain, aimed, denied, quoted = map(found.evidence, ("a fool stood", "you fool", "not a fool", "she said nothing. fool"))
    assert aimed > plain > denied > 0 and quoted == plain
    assert found.evidence("he wrote fool") < plain * 1.5 and found.evidence("blockhead") == plain
    assert found.evidence("kill the lights") == 0 < found.evidence("kill you")
    assert found.evidence("will not kill you") == 0 == found.evidence(None) == found.evidence("")


def test_words_and_patterns_have_weights_of_their_own():
    about = ["".join(chr(97 + i // 26 ** k % 26) for k in range(3)) for i in range(900)]
    texts = [f"x{w} oaf y{w}" for w in about[:300]] + [f"x{w} lout y{w}" for w in about[:60]]
    texts += [f"x{w} lout y{w}" for w in about[:12]] + [f"x{w} not oaf y{w}" for w in about[:20]] + [f"x{w} y{w}" for w in about]
    found = toxicity.learn(texts, np.array([1.0] * 360 + [0.0] * 932))
    # A word that clean documents hold too weighs less; what only clean documents deny weighs less than the machine says.
    assert found.words["oaf"] > found.words["lout"] > 0
    assert found.patterns["insult", 0.3] < 0.3 and found.evidence("an oaf") > found.evidence("a lout") > found.evidence("not a lout")
    assert found.evidence("kill you") == 2.0
    assert toxicity.Grammar(*found.__reduce__()[1]).evidence("not an oaf") == found.evidence("not an oaf")


def test_toxicity_learns_and_scores_all_rows(spark, tiny, odd):
    insults = ["oaf", "lout", "gromwort", "gromworts", "gromwortish"]
    rows, marks = [], []
    for i in range(400):
        words = sentence(60).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(insults))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 4 == 0)))
    labels = spark.createDataFrame(marks + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = tiny(rows)
    found = toxicity.fit(docs, labels)
    assert {"oaf", "lout"} <= set(found.words) and not set(VOCABULARY) & set(found.words)
    held = [r for r in toxicity.score(docs, found).collect() if r["held_out"]]
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert toxicity.score(odd, found).count() == len(ODD) and toxicity.score(tiny([]), found).count() == 0
    nothing = toxicity.fit(tiny([]), labels)
    assert [r["predicted"] for r in toxicity.score(tiny([(1, None)]), nothing).collect()] == [0]
