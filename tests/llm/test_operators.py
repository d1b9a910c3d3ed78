import hashlib
import math
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from labelgrid.llm import anchors, blocks, bpe, common, lines, lm, media, packing, queries, sharding, simhash, sketches, suffix, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

LONG = " ".join(f"word{k % 977} Ünï{k}" for k in range(9000))
SHARED = "a passage of well over fifty words that several documents carry: " + " ".join(f"term{k}" for k in range(60))
EDGE = [
    (1, "Hello World, it's 2024!"), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, LONG), (6, LONG), (None, "no id here, " + SHARED),
    (7, "中文 и русский ½ ٣ 　x\u001c\u0085y"), (8, "x" * 5000), (9, SHARED + " one"), (10, "two " + SHARED), (11, "a\nb\n\nc\r\n"), (12, "<|endoftext|> 's 'LL don't a<|startoftext|>b <|ENDOFTEXT|>"), (None, None),
]


@pytest.fixture(scope="module")
def edge(spark):
    """NULLs, empty and long texts, repeated rows, and extra columns named like internal ones."""
    rows = [(i, t, "k", 7, [1], "x", 0.5, 1) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, id int, spans array<int>, rk string, fp double, part int")


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_packing(spark, edge, none):
    got = packing.pack(edge, queries.word_bpe()).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.word_bpe())
    want = Counter()
    for i, t in EDGE:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_sequences(got)
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 4096) + 1  # three like remainders share none
    assert packing.pack(none, queries.word_bpe()).collect() == []


def check_sequences(rows):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_plan_is_optimal_on_small_instances():
    def optimum(items, cap):
        best = len(items)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for b in sorted(set(bins)):
                if b + items[k] <= cap:
                    rest = list(bins)
                    rest[rest.index(b)] += items[k]
                    go(k + 1, rest)
            go(k + 1, [*bins, items[k]])

        go(0, [])
        return best

    rng = random.Random(3)
    for _ in range(60):
        items = sorted((rng.randint(1, 30) for _ in range(rng.randint(0, 10))), reverse=True)
        plan = packing.plan(Counter(items), 30)
        used = Counter(s for p, n in plan for s in p * n)
        assert used == Counter(items) and all(sum(p) <= 30 for p, _ in plan)
        assert sum(n for _, n in plan) == optimum(items, 30)


def test_many_short_texts_share_sequences(spark):
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = packing.pack(rows, queries.word_bpe()).groupBy("sequence_id").agg(F.count("*").alias("n"), F.max("offset").alias("last"), F.countDistinct("offset").alias("places")).collect()
    assert len(got) == 25 and sum(r.n for r in got) == 100_000 and all(r.n == r.places == r.last + 1 for r in got)


def test_word_bpe_equals_the_library():
    from tokenizers import Tokenizer

    from labelgrid.llm.wordbpe import WordBpe

    whole, mine, rng = Tokenizer.from_file(queries.word_bpe()), WordBpe(queries.word_bpe()), random.Random(7)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "<|ENDOFTEXT|>", "don't", "'LL", "naïve", "ǅ", "½", "中", "e\u0301", "\u00a0", "\t", "\n", " ", "  ", "2024", "_-", "word", "Ωmega", "😀", "\x85", "\u3000", "\x1c"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in mine.encode(made)] == [whole.encode(t, add_special_tokens=False).ids for t in made]


def test_lm(spark, edge, none, docs):
    frame = spark.createDataFrame([(i, t) for i, t in docs.items()] + [(10**6, None), (10**6 + 1, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.lm_scores(frame).collect()}
    tokens = {i: [*WORD.findall((t or "").translate(LOW)), "\n"] for i, t in [*docs.items(), (10**6, None), (10**6 + 1, "")]}
    seen = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(seen.values()), len(seen)
    assert got.keys() == tokens.keys()
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(ws), sum(w in seen for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len(lm.lm_scores(edge).collect()) == len(EDGE)
    assert lm.lm_scores(none).collect() == []


def plain_lm(tokens):
    """The whole model by loops over tokens: scores of {id: words}."""
    training = {i: ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    count = Counter(w for ws in training.values() for w in ws)
    crc = lambda w: zlib.crc32(w.encode())
    top = sorted(count, key=lambda w: (-count[w], crc(w)))[: lm.TOP]

    def cls(w):
        if not count[w]:
            return 0
        return 1 + top.index(w) if w in top else 1 + lm.TOP + sum(count[w] >= x for x in (2, 3, 8, 64)) * lm.SHAPES + lm._shape(w.encode())

    def bucket(w):
        half = lm.BUCKETS // 2
        return top.index(w) if count[w] and w in top[:half] else half + crc(w) % half

    mass, contexts = Counter(), {}
    for w, c in count.items():
        mass[cls(w)] += c
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    unseen = once / (once + 2 * twice) if once else 0.0

    def steps(ws):
        for k, w in enumerate(ws):
            yield (ws[k - 1] if k else "\n"), (ws[k - 2] if k > 1 else "\n"), w

    pairs = {}
    for ws in training.values():
        for v, u, w in steps(ws):
            cell = contexts.setdefault((bucket(v), bucket(u)), np.zeros(lm.CLASSES))
            cell[cls(w)] += 1 - unseen * (count[w] == 1)
            cell[0] += unseen * (count[w] == 1)
            if cls(w) > lm.TOP:
                pairs.setdefault((v, cls(w)), Counter())[w] += 1
    def feats(a, b):
        return a, b, (a * 131 + b * 31) % lm.PAIRS

    def gather(of):
        out = [{}, {}, {}]
        for (a, b), cell in contexts.items():
            for table, f in zip(out, feats(a, b)):
                table[f] = table.get(f, 0) + of(a, b, cell)
        return out

    seen = gather(lambda a, b, cell: cell)
    prior = sum(seen[0].values()) + 0.5
    mean, weights = prior / prior.sum(), [{}, {}, {}]
    bias = np.log(mean)
    blank = np.log((20 * mean) / 20) - bias
    for f, cell in seen[0].items():
        weights[0][f] = np.log((cell + 20 * mean) / (cell.sum() + 20)) - bias

    def log_p(a, b):
        x = bias + weights[0].get(feats(a, b)[0], blank) + weights[1].get(feats(a, b)[1], 0) + weights[2].get(feats(a, b)[2], 0)
        return x - np.log(np.exp(x - x.max()).sum()) - x.max()

    for _ in range(lm.ROUNDS):
        have = gather(lambda a, b, cell: np.exp(log_p(a, b)) * cell.sum())
        for table, want, got in zip(weights, seen, have):
            for f in want:
                table[f] = table.get(f, 0) + 0.5 * (want[f] - got[f]) / (np.maximum(want[f], got[f]) + lm.EASE)
    fitted = {}
    for (v, c), ks in pairs.items():
        share, t = {w: count[w] / mass[c] for w in ks}, dict.fromkeys(ks, 0.0)
        norm = lambda: 1 - sum(share.values()) + sum(share[w] * math.exp(t[w]) for w in ks)
        for _ in range(lm.PAIR_ROUNDS):
            z = max(norm(), 1e-9)
            for w, k in ks.items():
                want = sum(ks.values()) * share[w] * math.exp(t[w]) / z
                t[w] += max(-lm.STEP, min(lm.STEP, (k - want - lm.PRIOR * t[w]) / (want + lm.PRIOR)))
        fitted[v, c] = t, norm()
    out = {}
    for i, ws in tokens.items():
        total = 0.0
        for v, u, w in steps(ws):
            c = cls(w)
            total += log_p(bucket(v), bucket(u))[c]
            if c > lm.TOP:
                t, z = fitted.get((v, c), ({}, 1.0))
                total += math.log(count[w] / mass[c]) + t.get(w, 0.0) - math.log(z)
        out[i] = total / math.log(10)
    return out


def test_lm_score_equals_plain_loops(spark, docs):
    rows = [(i, " ".join((t or "").split()[:60])) for i, t in list(docs.items())[:24]] + [(500, None), (501, "never met words only"), (502, list(docs.values())[2])]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = plain_lm({i: [*WORD.findall((t or "").translate(LOW)), "\n"] for i, t in rows})
    assert len(got) == len(want)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-5, abs_tol=1e-4), r
        assert math.isclose(r.gain, (r.score - r.base_score) / r.n_tokens)


def test_lm_pairs_are_a_distribution():
    rng = np.random.default_rng(3)
    trained, first = rng.integers(0, 4, 60).astype("f8"), np.arange(0, 60, 6)
    share = rng.random(60) / 8  # six words of a class that has others besides
    p = np.exp(lm.fit_pairs(trained, share, first)).reshape(-1, 6)
    none = lm.fit_pairs(np.zeros(60), share, first)
    assert np.allclose(none, np.log(share))
    for row, ks, bs in zip(p, trained.reshape(-1, 6), share.reshape(-1, 6)):
        other = row[ks == 0] / bs[ks == 0]  # words without a weight keep their proportions
        z = 1 / other[0] if len(other) else None
        assert z is None or (np.allclose(other, other[0]) and math.isclose(row[ks > 0].sum() + (1 - bs[ks > 0].sum()) / z, 1, rel_tol=1e-9))
        assert all(row[a] / bs[a] > row[b] / bs[b] for a in range(6) for b in range(6) if ks[a] > ks[b] + 1)


def test_lm_beats_a_bigram_count_model_on_held_out_texts(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    tokens = {r.doc_id: [*WORD.findall((r.text or "").translate(LOW)), "\n"] for r in frame.collect()}
    training = [ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = Counter(w for ws in training for w in ws), Counter(p for ws in training for p in zip(["\n", *ws], ws))
    got = [r for r in lm.lm_scores(frame).collect() if r.held_out]
    n = sum(r.n_tokens for r in got)
    bigram = 0.0
    for r in got:
        ws = tokens[r.doc_id]
        bigram += sum(math.log10((two[p] + 0.5) / (one[p[0]] + 0.5 * (len(one) + 1))) for p in zip(["\n", *ws], ws))
    mine, base = sum(r.score for r in got), sum(r.base_score for r in got)
    print(f"held out, log10 a token: model {mine / n:.4f}, unigram {base / n:.4f}, bigram {bigram / n:.4f}")
    assert mine > bigram and mine > base


def test_lm_classes_are_a_distribution():
    model = lm.Model(np.zeros(lm.CLASSES))
    rng = np.random.default_rng(0)
    model.one, model.two, model.pair = (rng.normal(size=x.shape) for x in (model.one, model.two, model.pair))
    assert np.allclose(np.exp(model.log_probs(np.arange(5))).sum(axis=2), 1)


def test_bpe_round_trip(spark, edge, none):
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})
    got = bpe.encoded(edge, RANKS, public_tokenizers.PATTERN, bpe.digest, bpe.DIGEST).collect()
    want = Counter()
    for i, t in EDGE:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert bpe.encoded(none, RANKS, public_tokenizers.PATTERN, bpe.digest, bpe.DIGEST).collect() == []
    rows = spark.createDataFrame([(1, enc.encode_ordinary("naïve 中 text")), (2, []), (3, None)], "n int, ids array<int>")
    assert [bytes(r.text).decode() if r.text is not None else None for r in bpe.decoded(rows, RANKS, "ids").orderBy("n").collect()] == ["naïve 中 text", "", None]
    named = bpe.decoded(rows.withColumnRenamed("n", "b"), RANKS, "ids")
    assert named.columns == ["b", "ids", "text"] and named.count() == 3
    with pytest.raises(Exception, match="no such id|out of bounds|INVALID_ARRAY_INDEX"):
        bpe.decoded(rows.limit(1).withColumn("ids", F.array(F.lit(10**8))), RANKS, "ids").collect()
    with pytest.raises(ValueError):
        bpe.encoded(edge.withColumnRenamed("key", "n_tokens"), RANKS, public_tokenizers.PATTERN, bpe.digest, bpe.DIGEST, id_col="n_tokens")


def test_splitter_equals_the_library():
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})
    split, one, rng = bpe.splitter(public_tokenizers.PATTERN), enc._core_bpe.encode_single_piece, random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("ab Zé\n\t'sßſ1²½_-.\x1c\x85\xa0 Ω中٣'rell\r　😀") for _ in range(rng.randint(0, 30)))
        assert [i for w in split(t) for i in one(w.encode())] == enc.encode_ordinary(t)


def removed(rows):
    """Brute force over (id, text) in order."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                mark[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        out.append((i, len(raw), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(bytes(c for c, m in zip(raw, mark) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_equals_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(suffix, "BUCKET", (300, 5000, 400_000)[seed])
    pool = ["".join(rng.choice("abcé") for _ in range(rng.randint(90, 400))) for _ in range(12)] + ["a" * 350, "ab" * 200]
    rows = [(k, "".join(rng.choice(pool)[rng.randint(0, 50) :] for _ in range(rng.randint(0, 6)))) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix.remove_repeats(frame, suffix.digest, suffix.DIGEST).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == removed(rows)


def test_suffix_dedup_edges(spark, edge, none):
    got = suffix.remove_repeats(edge, suffix.digest, suffix.DIGEST).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].n_bytes == by[2].n_removed == 0 and by[6].n_removed == by[6].n_bytes and by[5].n_removed < by[5].n_bytes
    assert by[9].n_removed > 300 and by[10].n_removed > 300
    assert by[8].n_removed == 4999 and by[8].n_spans == 1
    order = {None: -(2**63)}
    rows = sorted({(order.get(i, i), t or "") for i, t in EDGE if i != 6}, key=lambda r: r[0])
    once = {r[0]: r for r in removed([r for r in rows if r[0] is not None])}  # ids that occur once, against brute force
    for i in (1, 2, 3, 4, 5, 8, 9, 10, 11):
        assert tuple(by[i]) == once[i]
    assert suffix.remove_repeats(none, suffix.digest, suffix.DIGEST).collect() == []
    assert anchors.blocks_of([b"", b"x" * 99, b""])[2] is None


def test_long_texts_are_cut_without_losing_a_window(monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK", 700)
    rng = random.Random(4)
    for size in (0, 99, 100, 798, 799, 800, 5000):
        text = bytes(rng.randrange(97, 101) for _ in range(size))
        parts, seen, seeds = anchors.pieces(text), [], {}
        for a, piece in parts:
            _, starts, found = anchors.blocks_of([piece])
            for first, n, anchor, seed in zip(found.first, found.windows, found.anchor, found.seed) if found else []:
                seen += range(a + first, a + first + n)
                assert seeds.setdefault(text[a + anchor : a + anchor + anchors.SEED], seed) == seed
        assert seen == list(range(max(0, size - 99)))


def test_lines(spark, edge, none):
    rows = [(k, f"Own line number {k} of this text {'abcdefgh'[k]}\nServed request {k} in 5{k} ms from host h{k}\nrest") for k in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.drop_recurring_lines(frame).collect()}
    assert got[0].lines_dropped == 0 and got[0].text == rows[0][1]
    for k in range(1, 8):
        assert "Served" not in got[k].text and got[k].text.endswith("rest") and got[k].lines_total == 3
    few = lines.drop_recurring_lines(frame.where("doc_id < 4")).agg(F.sum("lines_dropped")).first()[0]
    assert few == 0
    out = lines.drop_recurring_lines(edge)
    assert out.columns[: len(edge.columns)] == edge.columns and out.count() == len(EDGE)
    assert {(r.doc_id, r.text) for r in out.collect()} == set(EDGE)
    assert lines.drop_recurring_lines(none).collect() == []


def test_a_leaf_has_many_templates(spark):
    rows = [(k, f"please see our privacy policy page today\nown {'abcdefghijklmnopqrst'[k]}") for k in range(20)]
    rows += [(100 + k, f"please see our returned goods form instead\nown {'abcdefghijklmnopqrst'[k]}") for k in range(12)]
    rows += [(200 + k, f"please see our {'abcdef'[k]}x {'ghijkl'[k]}y {'mnopqr'[k]}z now") for k in range(6)]  # too little in common
    rows += [(300 + k, f"please see our helpful {'abcdefgh'[k]}desk staff soon") for k in range(8)]  # a variable field
    got = {r.doc_id: r.lines_dropped for r in lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i < 200 and i % 100 > 0 or i > 300) for i, _ in rows}


def test_lines_of_long_texts(spark):
    rows = [(k, "\n".join(f"{'boiler plate line' if j % 2 else f'w{chr(97 + k)} own{j}x {j}'}" for j in range(4000))) for k in range(6)]
    got = {r.doc_id: r for r in lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        want = [x for n, x in enumerate(t.split("\n")) if x != "boiler plate line" or (k == 0 and n == 1)]
        kept = [x for x in got[k].text.split("\n")]
        assert [x for x in kept if x == "boiler plate line"] == ["boiler plate line"] * (k == 0) and got[k].lines_total == 4000
        assert got[k].lines_dropped == 4000 - len(kept) and set(kept) <= set(want)


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOW))
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, edge, none, docs):
    rows = [*docs.items(), *[(i + 10**6, t) for i, t in EDGE if i is not None]]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(fps)
    for n, a in enumerate(order):
        for b in order[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", find(i)) for i in fps}
    assert simhash.near_duplicates(edge).count() == len(EDGE)
    assert simhash.near_duplicates(none).collect() == []


def test_spark_hash_is_the_contracts(spark):
    h = spark.sql("SELECT xxhash64('a b c')").first()[0]
    assert h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("limit", [10, 10**9])
def test_shard_forest_keeps_all_components(limit, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", limit)
    rng = random.Random(2)
    base, values = [rng.getrandbits(64) for _ in range(10)], set()
    while len(values) < 500:
        v = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    flat = sorted(values)

    def parts(edges):
        root = {v: v for v in flat}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(v for v in flat if find(v) == find(u)) for u in flat}

    want = [(a, b) for k, a in enumerate(flat) for b in flat[:k] if (a ^ b).bit_count() <= 2]
    assert parts(simhash.shard_links(np.array(flat, "u8"))) == parts(want)


def test_near_copies(spark, none):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(400)]
        for c in range(3):
            text = list(base)
            for _ in range(3 * (c > 0)):
                text[rng.randrange(400)] = "edit"
            rows.append((10 * g + c, " ".join(text)))
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}
    assert simhash.near_copies(none).collect() == []


@pytest.mark.parametrize("replaced, least", [(34, 0.9), (16, 0.96)])  # a likeness of about 0.85 and 0.92 (a run of edits loses four more shingles than words)
def test_near_copies_recall(spark, replaced, least):
    rng = random.Random(replaced)
    rows = []
    for g in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(404)]
        at = rng.randrange(404 - replaced)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:at] + [f"z{rng.randrange(10**6)}" for _ in range(replaced - 4)] + base[at + replaced - 4 :]))]
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] // 2 == i // 2 for i, _ in rows)
    assert sum(got[2 * g + 1] == 2 * g for g in range(400)) >= least * 400


def test_toxicity_held_out(spark, edge, none):
    sf = "/root/testdata/sf0.1"
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(frame, toxicity.chain_labels(labels.where("doc_id % 4 > 0")), toxicity.CATEGORIES, sample=3000)
    scored = toxicity.score(frame.select("doc_id", "text"), chain).join(labels.where("doc_id % 4 = 0"), "doc_id")
    hits = {(r.toxic, r.found): r["count"] for r in scored.groupBy("toxic", (F.col("p_toxic") >= toxicity.THRESHOLD).alias("found")).count().collect()}
    assert hits.get((0, True), 0) <= 0.01 * hits[0, False]
    assert hits.get((1, False), 0) <= 0.1 * hits[1, True]
    out = toxicity.score(edge, chain)
    assert out.count() == len(EDGE) and out.columns == [*edge.columns, "p_junk", "p_toxic"]
    assert toxicity.score(none, chain).collect() == []
    blank = toxicity.train(none, toxicity.chain_labels(labels.limit(0)), toxicity.CATEGORIES)
    assert toxicity.score(edge, blank).where("p_toxic is null").count() == 0


def sketch(text):
    ws = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]

    def run(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        return seed

    short = 42
    for w in ws[:5]:
        short = run([short, w])
    hashes = {run(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({short} if ws else set())
    return sorted(h - (h >> 63 << 64) for h in hashes)[:128]


def test_fingerprints(spark, edge, none, docs):
    rows = sorted([*list(docs.items())[:60], (10**6, None), (10**6 + 1, "one two"), (10**6 + 2, "ß" * 9)])
    got = {r.doc_id: r for r in sketches.edited_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = sketch(t), sketch(edited), sketch(after)

        def near(x, y):
            union = sorted({*x, *y})[:128]
            return sum(h in x and h in y for h in union) / len(union) if union else 1.0

        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{h % 2**64:016X}" for h in a) and r.edited_fingerprint == "".join(f"{h % 2**64:016X}" for h in b)
        assert (r.near_edited, r.near_next) == (near(a, b), near(a, c))
    assert sketches.edited_documents(edge).count() == len(EDGE)
    assert sketches.edited_documents(none).collect() == []


def test_sketches_merge(spark):
    frame = spark.createDataFrame([(1, " ".join(f"a{k}" for k in range(900))), (1, " ".join(f"a{k}" for k in range(400, 1500)))], "g int, text string")
    made = sketches.with_sketch(frame, "text", "s")
    whole = sketches.fold(made, ["g"], "s").select(sketches.distinct_count(F.col("s")).alias("n"), "s").first()
    want = sorted({h for r in frame.collect() for h in full(r.text)})[:128]
    assert whole.s == want and abs(whole.n - 1492) < 450
    blank = spark.createDataFrame([(1, ""), (2, None), (None, "one two three four five"), (3, "x")], "g int, text string")
    sizes = {r.g: len(r.s) for r in sketches.fold(sketches.with_sketch(blank, "text", "s"), ["g"], "s").collect()}
    assert sizes == {1: 0, 2: 0, None: 1, 3: 1}
    assert sketches.fold(made.limit(0), ["g"], "s").collect() == []
    a, b = (F.array(*[F.lit(x).cast("long") for x in xs]) for xs in ([1, 2, 3], [2, 3, 4, 5]))
    assert tuple(spark.range(1).select(sketches.resemblance(a, b), sketches.containment(a, b)).first()) == (0.4, 2 / 3)


def full(text):
    ws = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()]
    out = set()
    for k in range(len(ws) - 4):
        seed = 42
        for v in ws[k : k + 5]:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        out.add(seed - (seed >> 63 << 64))
    return out


@pytest.mark.parametrize("how", [media.RAW, media.PACKBITS, media.LZW, media.DEFLATE])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("bits", [8, 16])
def test_tiff_round_trip(how, order, bits):
    rng = np.random.default_rng(1)
    for predictor in (1, 2):
        for tile in (0, 16):
            pages = []
            for w, h, c in ((33, 70, 3), (1, 1, 1), (200, 40, 1)):
                data = (np.cumsum(rng.integers(0, 3, w * h * c)) // 5 % (1 << bits)).astype("<u1" if bits == 8 else "<u2").tobytes()
                pages.append(media.Page(w, h, c, bits, how, data))
            assert list(media.read_pages(media.write_pages(pages, order, predictor, tile, rows=16))) == pages


def test_tiff_codecs():
    # The standard's own PackBits example.
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert media.unpack_bits(packed, 99) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    rng = random.Random(1)
    for n in (0, 1, 2, 300, 5000, 60000):
        for data in (bytes(rng.randrange(256) for _ in range(n)), bytes(rng.randrange(3) for _ in range(n)), b"a" * n):
            assert media.unlzw(media.lzw(data), n + 9) == data and media.unpack_bits(media.pack_bits(data), n + 9) == data


def test_tiff_frames(spark, edge, none):
    good = media.write_pages([media.Page(2, 1, 1, 8, media.RAW, b"ab")] * 2)
    loop = bytearray(media.write_pages([media.Page(2, 1, 1, 8, media.RAW, b"ab")]))
    loop[-4:] = loop[4:8]
    frame = spark.createDataFrame([(1, good), (2, bytes(loop)), (3, b"junk"), (4, None), (5, good[:20])], "page_id int, media binary")
    got = media.tiff_pages(frame, "media", ["page_id"]).orderBy("page_id", "page").collect()
    assert [(r.page_id, r.page, r.error is None) for r in got] == [(1, 0, True), (1, 1, True), (2, None, False), (3, None, False), (4, None, False), (5, None, False)]
    assert bytes(got[0].samples) == b"ab"
    stored = media.texts_as_media(edge)
    rows = media.tiff_pages(stored, "media", ["doc_id", "n_bytes", "payload_bytes"], media.page_digest, media.DIGEST).collect()
    want = Counter()
    for i, t in EDGE:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert media.texts_as_media(none).collect() == []


def test_tiff_damage_is_an_error_never_a_crash(spark):
    rng = random.Random(11)
    made = []
    for how in (media.RAW, media.PACKBITS, media.LZW, media.DEFLATE):
        for order, predictor, tile in (("<", 1, 0), (">", 2, 0), ("<", 2, 16)):
            page = media.Page(20, 30, 3, 8, how, bytes(rng.randrange(4) for _ in range(1800)))
            good = media.write_pages([page], order, predictor, tile, rows=8)
            made += [good[:n] for n in range(0, len(good), 37)]
            for _ in range(60):
                bad = bytearray(good)
                for _ in range(rng.randint(1, 4)):
                    bad[rng.randrange(len(bad))] = rng.choice((0, 1, 255, rng.randrange(256)))
                made.append(bytes(bad))
            for _ in range(30):  # fields of the directory: counts, types and values
                bad = bytearray(good)
                bad[len(bad) - 1 - rng.randrange(180)] = rng.choice((0, 0, 255))
                made.append(bytes(bad))
    frame = spark.createDataFrame(list(enumerate(made)), "n int, media binary")
    rows = media.tiff_pages(frame, "media", ["n"], lambda p: (len(p.samples),), "size bigint").collect()
    assert {r.n for r in rows} == set(range(len(made)))
    assert all((r.error is None) == (r.size is not None) for r in rows) and sum(r.error is not None for r in rows) > 200
    # A small file that claims a large page, and a bomb: refused, or expanded no further than the page.
    bomb = media.write_pages([media.Page(64, 3, 3, 8, media.DEFLATE, b"a" * 576)])
    at = bomb.rindex(zlib.compress(b"a" * 576, 1))
    huge = bytearray(media.write_pages([media.Page(2, 2, 1, 8, media.RAW, b"abcd")]))
    k = huge.index(__import__("struct").pack("<HHII", 256, 4, 1, 2))
    huge[k + 8 : k + 12] = b"\xff\xff\xff\x7f"
    assert at >= 0 and len(media.expand(zlib.compress(b"a" * 10**7), media.DEFLATE, 576)) == 576
    assert [r.error is None for r in media.tiff_pages(spark.createDataFrame([(bytes(huge),), (b"",)], "media binary"), "media", []).collect()] == [False, False]
    with pytest.raises(ValueError):
        media.tiff_pages(frame.withColumnRenamed("n", "page"), "media", ["page"])


def test_sharding_edges(spark, edge, none):
    rows = [(None, 400)] * 30 + [(1, 300)] * 20 + [(2, 5000), (3, None)] + [(k, 90) for k in range(100, 300)]
    got = sharding.extendible_shards(spark.createDataFrame(rows, "k long, n long"), "k", F.col("n"), 1000).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in got:
        size[r.shard] += r.n_bytes
    assert all(size[r.shard] == r.shard_bytes and (r.shard_bytes <= 1000 or r.oversized) for r in got)
    assert sum(r.oversized for r in got) == 1
    assert sharding.extendible_shards(edge, "doc_id", F.octet_length("text"), 1000).count() == len(EDGE)
    assert sharding.extendible_shards(none, "doc_id", F.octet_length("text"), 1000).collect() == []


def test_pipeline_stages(spark, none):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "kalmorpinsu" for b in ("tev", "dar", "lin", "osk", "bem", "ruf", "gha")]
    own = lambda n: " ".join("".join(rng.choice(words) for _ in range(2)) for _ in range(n))
    clean = [(k, own(120)) for k in range(30)]
    copy = (100, clean[3][1])
    edited = clean[5][1].split()
    edited[40] = "changed"
    toxic = [(200 + k, own(30) + " idiot moron scum worthless loser stupid pathetic clown trash disgusting " + own(20)) for k in range(3)]
    passage = own(70)
    carry = [(300 + k, own(60) + " " + passage + " " + own(60)) for k in range(2)]
    rows = [*clean, copy, (101, " ".join(edited)), *toxic, *carry, (None, own(50)), (400, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.1"
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    chain = toxicity.train(all_docs, toxicity.chain_labels(spark.read.parquet(f"{sf}/labels.parquet")), toxicity.CATEGORIES, sample=3000)
    kept = toxicity.score(docs, chain).where("p_toxic < 0.5").select(*docs.columns)
    assert {r.doc_id for r in docs.select("doc_id").subtract(kept.select("doc_id")).collect()} == {200, 201, 202}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = corpus_pipeline.materialize(stage(spark, kept, sf), "test")
        assert kept.columns == docs.columns, name
    left = {r.doc_id: r for r in kept.collect()}
    assert set(left) == {*range(30), 300, 301, None, 400} and kept.count() == 34
    assert all(left[i].text == t for i, t in clean) and passage in left[300].text and passage not in left[301].text
    packed = corpus_pipeline.pack(spark, kept, sf).collect()
    check_sequences(packed)
    assert {r.doc_id for r in packed} == set(left)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), sf).collect() == []


def test_near_copies_checks_equal_fingerprints(spark):
    # The run of one word fills over half of the positions, so it alone makes the fingerprint.
    rng = random.Random(6)
    rows = [(k, " ".join([f"u{rng.randrange(10**6)}" for _ in range(60)] + ["x"] * 100)) for k in range(6)]
    rows += [(10, rows[0][1] + " x x"), (11, rows[1][1])]  # the same shingles, repeated
    assert len({simhash.fingerprint(t, 5) for _, t in rows}) == 1
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(6)} | {10: 0, 11: 1}


def test_near_copies_crowded_shard():
    # More fingerprints of one table's bits than a tree takes; the two of a pair are 19 bits apart.
    rng = random.Random(1)
    fixed = simhash._table_bits(0)[: simhash.TABLE_BITS]
    free = [k for k in range(128) if k not in fixed]
    rows = []
    for n in range(simhash.TREE):
        v = sum(rng.getrandbits(1) << k for k in free)
        rows += [(w % 2**64, w >> 64, 2 * n + k) for k, w in enumerate((v, v ^ sum(1 << k for k in rng.sample(free, 19))))]
    root = list(range(len(rows)))
    for a, b in simhash._near(np.array(rows, "u8")):
        root = [root[b] if r == root[a] else r for r in root] if root[a] != root[b] else root
    assert all(root[2 * n] == root[2 * n + 1] for n in range(simhash.TREE))


def star(rng, copies):
    """A source of 304 words and copies that lost 26 shingles each elsewhere: 0.84 like it, 0.71 like each other."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(304)]
    out = [" ".join(base)]
    for _ in range(copies):
        at = rng.randrange(4, 274)
        out.append(" ".join(base[:at] + [f"z{rng.randrange(10**6)}" for _ in range(22)] + base[at + 22 :]))
    return out


def test_near_copies_failed_candidates_hide_no_link(spark):
    rng = random.Random(8)
    rows = [(100 * g + k, t) for g in range(30) for k, t in enumerate(star(rng, 20))]
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: simhash.shingles(t, 5) for i, t in rows}
    bottom = {i: np.unique(h)[: simhash.SKETCH] for i, h in sets.items()}
    first = {i: simhash.majority(h) for i, h in sets.items()}
    both = {i: first[i] | simhash.majority(simhash._rehashed(h)) << 64 for i, h in sets.items()}
    masks = [sum(1 << k for k in simhash._table_bits(n)) for n in range(simhash.TABLES)]

    def linked(a, b):
        union = np.union1d(bottom[a], bottom[b])[: simhash.SKETCH]
        alike = len(np.intersect1d(np.intersect1d(bottom[a], bottom[b]), union)) / len(union) >= simhash.SIMILARITY
        return alike and (both[a] ^ both[b]).bit_count() <= simhash.REACH and any(not (first[a] ^ first[b]) & m for m in masks)

    want = [(g, g + k) for g in range(0, 3000, 100) for k in range(1, 21) if linked(g, g + k)]
    assert len(want) > 450 and [(a, b) for a, b in want if got[a] != got[b]] == []


def test_joined_equals_brute_force():
    rng = random.Random(3)
    for n in (5, 60, 200):
        sets = []
        for _ in range(n):
            base = sets[rng.randrange(len(sets))] if sets and rng.random() < 0.8 else np.array([rng.getrandbits(64) for _ in range(rng.choice((10, 128, 200)))], "u8")
            cut = base[np.array([rng.random() > 0.08 for _ in base], bool)]
            sets.append(np.unique(np.append(cut, np.array([rng.getrandbits(64) for _ in range(3)], "u8"))))
        sets = [s[: simhash.SKETCH] for s in sets]
        roots = np.array([rng.randrange(n) for _ in range(n)])

        def near(x, y):
            union = np.union1d(x, y)[: simhash.SKETCH]
            return len(np.intersect1d(np.intersect1d(x, y), union)) / max(len(union), 1)

        def parts(edges):
            at = {r: r for r in roots.tolist()}
            for a, b in edges:
                at = {k: at[b] if v == at[a] else v for k, v in at.items()} if at[a] != at[b] else at
            return {frozenset(k for k in at if at[k] == v) for v in at.values()}

        want = [(int(roots[a]), int(roots[b])) for a in range(n) for b in range(a) if near(sets[a], sets[b]) >= 0.8]
        got = simhash.joined(np.array([len(s) for s in sets]), np.concatenate(sets), roots, 0.8, 16)
        assert parts(got) == parts(want) and len(got) == len(set(roots.tolist())) - len(parts(want))


def test_searched_deals_large_groups(spark, monkeypatch):
    rng = random.Random(5)
    bottom = [np.unique(simhash.shingles(t, 5))[: simhash.SKETCH] for _ in range(6) for t in star(rng, 9)]
    rooted = spark.createDataFrame([(k, b.view("i8").tolist()) for k, b in enumerate(bottom)], "root long, sketch array<long>")
    groups = spark.createDataFrame([(k, 0) for k in range(1, len(bottom))], "node long, root long")
    found = []
    for limit in (1500, 10):
        monkeypatch.setattr(simhash, "TREE", limit)
        root = list(range(len(bottom)))
        for e in simhash._searched(rooted, groups, 0.8).collect():
            root = [min(root[e.a], root[e.b]) if r in (root[e.a], root[e.b]) else r for r in root]
        found.append(root)
    want = list(range(len(bottom)))
    for x in range(len(bottom)):
        for y in range(x):
            union = np.union1d(bottom[x], bottom[y])[: simhash.SKETCH]
            if len(np.intersect1d(np.intersect1d(bottom[x], bottom[y]), union)) >= 0.8 * len(union):
                want = [min(want[x], want[y]) if r in (want[x], want[y]) else r for r in want]
    assert found == [want, want]


def test_plan_is_never_worse_than_best_fit():
    def best_fit(items, cap):
        rooms = []
        for s in sorted(items, reverse=True):
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else cap) - s)
        return len(rooms)

    rng = random.Random(1)
    cases = [[1400] * 300 + [rng.randint(100, 3000) for _ in range(600)], [900] * 300 + [rng.randint(300, 2500) for _ in range(600)], [rng.randint(1000, 2100) for _ in range(400)]]
    cases += [[1] * 9000 + [3000] * 3 + [4000] * 2, [1000] * 8]  # thousands of pieces in one sequence
    for items in cases:
        plan = packing.plan(Counter(items), 4096)
        used = Counter()
        for p, n in plan:
            used += Counter({s: k * n for s, k in Counter(p).items()})
        assert used == Counter(items) and all(sum(p) <= 4096 for p, _ in plan)
        want = best_fit(items, 4096) if len(items) < 2000 else 7
        assert sum(n for _, n in packing.best_fit(Counter(items), 4096)) == want >= sum(n for _, n in plan)


def test_pipeline_drops_short_recurring_lines(spark):
    rows = [(k, f"Read more\nown words of text {'abcdefgh'[k]}{k} {k}\n\nSubscribe\n{'ijklmnop'[k]}") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()}
    assert got[0] == rows[0][1]
    for k in range(1, 8):
        left = got[k].split("\n")
        assert "Read more" not in left and "Subscribe" not in left and left[-2:] == ["", "ijklmnop"[k]]


def test_near_copies_against_brute_force(spark):
    """Exact likeness of all pairs of sf0.01: pairs of 0.8 and more share a group, and a group hangs together by such pairs or nearly."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, where = {i: frozenset(simhash.shingles(t or "", 5).tolist()) for i, t in rows}, {}
    for i, s in sets.items():
        for h in s:
            where.setdefault(h, []).append(i)
    common = Counter((a, b) for ids in where.values() if len(ids) > 1 for k, a in enumerate(ids) for b in ids[:k])
    near = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in common.items()}
    want = [p for p, j in near.items() if j >= 0.8]
    found = sum(got[a] == got[b] for a, b in want)
    print(f"near copies: {found} of {len(want)} pairs")
    assert len(want) > 20 and found >= 0.9 * len(want)
    loose = {i: i for i in sets}

    def root(i):
        while loose[i] != i:
            i = loose[i]
        return i

    for (a, b), j in near.items():
        if j >= 0.68:  # four standard errors of a sketch below
            loose[root(a)] = root(b)
    blank = [i for i, s in sets.items() if not s]
    assert all(root(i) == root(g) or (i in blank and g in blank) for i, g in got.items())


def plain_packing(rows):
    from tokenizers import Tokenizer

    whole, out = Tokenizer.from_file(queries.word_bpe()), Counter()
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            out[i, n, at, len(ids[at : at + 4096])] += 1
    return out


def test_pipeline_runs_whole(spark, tmp_path):
    """The whole pipeline over a small folder of its own: toxic documents, copies and repeats go, all others are packed, and its scratch goes."""
    rng = random.Random(2)
    bad = "idiot moron scum worthless loser stupid pathetic clown trash disgusting".split()
    vocabulary = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    own = lambda n, more=(): " ".join(rng.sample([*(rng.choice(vocabulary) for _ in range(n)), *more], n + len(more)))
    rows = [(k, own(150), 0) for k in range(150)] + [(1000 + k, own(40, rng.sample(bad, 7)), 1) for k in range(60)]
    extra = [(2000, rows[5][1]), (2001, own(60) + " " + " ".join(rows[9][1].split()[20:110]) + " " + own(60)), (None, own(70)), (2002, None), (2003, "")]
    frame = [(i, t, "en", "s", len(t or "")) for i, t, *_ in [*rows, *extra]]
    sf = str(tmp_path)
    spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    labels = [(i, 1, y) for i, _, y in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, *_ in frame if i is None or not 1000 <= i < 2000}
    got = corpus_pipeline.run(spark, sf).collect()
    check_sequences(got)
    passage = " ".join(rows[9][1].split()[20:110])
    left = [(i, t) for i, t, *_ in frame if i is None or not 1000 <= i < 2001]
    texts = {i: t for i, t in left}
    assert passage in texts[2001]
    # Texts without words are one group: of 2002 and 2003 the smaller id stays.
    want = plain_packing([(i, t) for i, t in left if i not in (2001, 2003)])
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got if r.doc_id != 2001) == want
    assert 100 < sum(r.length for r in got if r.doc_id == 2001) < 500
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.collect() == []
        none = docs.limit(0) if "text" not in none.columns else none


def test_a_worker_returns_what_it_no_longer_needs():
    """Before a stage what other operators kept goes, after it the memory that is free; its own stays."""
    anonymous = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
    common.per_worker("one x", lambda: 1)

    def run(batches):
        common.per_worker("two x", lambda: 2)
        small = [np.ones(4000) for _ in range(4000)]  # 128 MB below the size that malloc maps, freed around what stays
        stays = [small[k].copy() for k in range(0, 4000, 400)]
        yield from batches
        del small
        yield stays

    before = anonymous()
    kept = list(common.frugal("two", run)([1, 2]))
    assert kept[:2] == [1, 2] and anonymous() - before < 40
    assert sorted(sys._labelgrid_kept) == ["two x"]
    del sys._labelgrid_kept["two x"]


def test_blocks_are_found_in_little_memory():
    """The task's memory is that of a chunk and of the blocks, some of it for each byte of a chunk."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh ", k=1_000_000)) for _ in range(6)]
    batch = pa.record_batch([pa.array(range(6), pa.int64()), pa.array([0] * 6, pa.int64()), pa.array(texts)], names=["doc", "tie", "text"])
    anchors._powers.clear()
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in suffix._find_blocks([batch]))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert n > 100_000 and peak < 150, peak


def test_parts_of_a_block_are_the_whole_block():
    places = [np.array(p, "u4") for p in ([0, 1, 0, 2], [], [3, 0, 4], [1], [], [5, 5, 6], [])]
    codes, _, _ = blocks.recoded(places, 7)
    sizes, whole = np.array([len(p) for p in places]), blocks.resolve(codes, 7)
    for limit in (1, 2, 4, 5, 100):
        got = list(blocks.parts(sizes, codes, 7, limit))
        assert [a for a, _, _ in got] == [0, *(b for _, b, _ in got)][: len(got)] and got[-1][1] == len(sizes)
        assert all(len(w) == sizes[a:b].sum() and (len(w) <= limit or b == a + 1) for a, b, w in got)
        assert np.concatenate([w for _, _, w in got]).tolist() == whole.tolist()


def test_bpe_joins_small_parts(spark, edge, monkeypatch):
    """A block's documents come in several rows, none of more words than a part but for a long document, and no row is lost."""
    plain = bpe.encoded(edge, RANKS, public_tokenizers.PATTERN, bpe.digest, bpe.DIGEST)
    monkeypatch.setattr(bpe, "PART", 30)
    cut = bpe.encoded(edge, RANKS, public_tokenizers.PATTERN, bpe.digest, bpe.DIGEST)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256)
    assert sorted(map(key, cut.collect())) == sorted(map(key, plain.collect()))


def test_lm_block_is_a_few_bytes_a_token():
    """A block of a million tokens in memory: four numbers of four bytes a token, and the steps to them."""
    rng = np.random.default_rng(3)
    drawn = np.unique(rng.zipf(1.3, 1_000_000).clip(1, 5000), return_inverse=True)[1].astype("u4")
    places = np.split(drawn, 100)
    codes, _, counts = blocks.recoded(places, int(drawn.max()) + 1)
    table = lm._table([(b"w%d" % k, int(c) * 3) for k, c in enumerate(sorted(counts.tolist(), reverse=True))])
    body = blocks.bundle(blocks.pack(np.array([len(p) for p in places], "u4")), blocks.pack(codes), table)
    tracemalloc.start()
    try:
        block = lm.Block(body, lm.Lexicon(3_000_000, len(counts), 10, 10, [(zlib.crc32(b"w0"), int(counts.max()) * 3)]))
        held, peak = (x / 1e6 for x in tracemalloc.get_traced_memory())
    finally:
        tracemalloc.stop()
    assert len(block.word) == 1_000_000 and block.counts[block.word].sum() == (3 * counts.astype("i8") ** 2).sum()
    assert held < 20 and peak < 32, (held, peak)


def test_lm_pair_keys_need_little_memory():
    """Keys of a million tokens: the twelve bytes of each that are returned, and the steps to them a slice at a time."""
    rng = np.random.default_rng(4)

    class Few:
        name, cls = rng.integers(0, 2**63, 5000).astype("u8"), rng.integers(0, 121, 5000).astype("i4")
        word = rng.integers(0, 5000, 1_000_000).astype("i4")
        prev = np.roll(word, 1)

    at = np.arange(1_000_000, dtype="i4")
    tracemalloc.start()
    try:
        dealt, keys = lm.pair_keys(Few, at)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    group = lm._mixed(Few.name[Few.prev] + Few.cls[Few.word].astype("u8"))
    assert (dealt == group >> np.uint64(32)).all() and (keys >> np.uint64(24) == group & np.uint64(0xFFFFFFFF)).all()
    assert (keys & np.uint64(0xFFFFFF) == Few.name[Few.word] & np.uint64(0xFFFFFF)).all()
    assert peak < 28, peak
