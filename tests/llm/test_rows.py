"""Top-k search, sharding, packing, mixing."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import oracle_check
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lipikar.llm import mixing, packing, queries, sharding, topk

TOKENIZER = queries.tokenizer_path()


def test_op3_against_sql(spark, tiny):
    assert oracle_check.compare(spark, queries.op3_topk, queries.oracle_sql()["op3_topk"], tiny) is None


def exact_topk(rows, k=5):
    """Brute force in whole numbers, scores held within 64 bits."""
    def component(x):
        return math.floor(Fraction(x) * 256)

    ok = [(i, [component(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for q, v in ok:
        if q % 50 == 0:
            held = lambda s: max(-(2**63), min(2**63 - 1, s))
            scored = sorted((-held(sum(a * b for a, b in zip(v, w))), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            want.update((q, n, i, -s) for n, (s, i) in enumerate(scored, 1))
    return want


SMALL = topk.TopKParams(pivots=3, least_rows=16, groups=6, run=2)


def found_topk(spark, rows, params=SMALL):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search_topk(df, F.col("vec_id") % 50 == 0, params).collect())


def test_op3_hard_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1e7 if i % 40 == 7 else 0.25]) for _ in range(4)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0]), (250, [float("nan")] * 4), (251, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (252, []), (300, [9.0, 9.0]), (301, [1.0, 1.0]), (50, rows[50][1])]
    assert found_topk(spark, rows) == exact_topk(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert topk.search_topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0 and topk.search_topk(df, F.lit(False)).count() == 0


def test_op3_magnitudes(spark):
    """Large components on either side, scores beyond a double's precision, and beyond 64 bits."""
    rows = [(0, [3 / 256, 5 / 256]), (1, [float(2**53 - 1) / 256, 1 / 256]), (2, [float(2**53 - 3) / 256, 2 / 256]), (3, [1.0, 1.0]), (4, [-2.5, 1e12]), (5, [0.1, 0.2])]
    assert found_topk(spark, rows) == exact_topk(rows)
    assert {(r[2], r[3]) for r in found_topk(spark, rows)} >= {(1, 27021597764222978), (2, 27021597764222977)}
    huge = [*rows, (6, [1e300, -1e300]), (7, [-1e300, 1e3]), (50, [1e300, 2.0]), (51, [1.7e308, 1.0]), (52, [-1.7e308, -1.0])]
    assert found_topk(spark, huge) == exact_topk(huge)


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_op3_clusters(spark, seed):
    rng = np.random.RandomState(seed)
    centres = rng.uniform(-20, 20, (7, 5))
    rows = [(int(i), [float(x) for x in centres[i % 7] + rng.normal(0, 0.3, 5)]) for i in rng.permutation(400)]
    rows += rows[:9]
    assert found_topk(spark, rows) == exact_topk(rows)


def test_op3_annuli_are_skipped():
    rng = np.random.RandomState(0)
    centres = rng.randint(-4000, 4000, (8, 6)).astype(float)
    m = np.concatenate([c + rng.randint(-20, 20, (600, 6)) for c in centres])
    d = topk.distances(m, centres)
    order = np.lexsort((d.min(axis=1), d.argmin(axis=1)))
    q = topk.Queries(np.array([-1]), m[:1], 5)
    visited = topk.search_rows(q, centres, np.arange(len(m))[order], d.argmin(axis=1)[order], d.min(axis=1)[order], m[order])
    exact = sorted(((-int(s), i) for i, s in enumerate(m @ m[0])))[:5]
    assert q.best[0] == exact and visited < 12  # of 24


def check_shards(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    sizes = [sum(r.size for r in by[k]) for k in range(n)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_op4_query(spark, tiny):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.op4_sharding(spark, tiny).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r["size"] == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
    check_shards(got, 8)
    order = [r.shard for r in sorted(got, key=lambda r: r.doc_id)]
    assert order == sorted(order)


def test_op4_odd_rows_and_files(spark, odd, nothing, tiny, tmp_path):
    got = sharding.assign_shards(odd, 3).collect()
    assert len(got) == 11 and sum(r["size"] == 1 for r in got) == 3
    assert sharding.assign_shards(nothing, 3).count() == 0
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    sizes = [r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()]
    assert len(sizes) == 5 and spark.read.parquet(str(tmp_path / "out")).count() == docs.count() and max(sizes) - min(sizes) < 40_000


def test_op4_law_against_brute_force(spark):
    """Every row's shard and slot from one running sum over the sorted rows."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(60)]), "x" * rng.randrange(0, 90)) for _ in range(300)] + [(7, "same")] * 120
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.assign_shards(df, 6).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total, before = sum(len(t) + 1 for _, t in rows), 0
    want = Counter()
    ranked = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id is not None, r.doc_id or 0) for r in ranked] == sorted((i is not None, i or 0) for i, _ in rows)
    for r in ranked:
        assert r.shard == min(5, (2 * before + r.size) * 6 // (2 * total))
        before += r.size
        want[r.shard] += 1
    assert all(sorted(x.slot for x in by[k]) == list(range(n)) for k, n in want.items())


def test_op4_equal_rows_are_cut(spark, odd, nothing, tmp_path):
    df = spark.createDataFrame([(None, "same text", k) for k in range(40)], "doc_id long, text string, shard int").repartition(3)
    folder = sharding.write_shards(df, str(tmp_path / "equal"), 4)
    back = spark.read.parquet(str(tmp_path / "equal"))
    assert folder == "_shard" and sorted(r.shard for r in back.collect()) == list(range(40))
    assert sorted(r["count"] for r in back.groupBy(folder).count().collect()) == [10] * 4
    for name, table in (("odd", odd), ("nothing", nothing)):
        sharding.write_shards(table, str(tmp_path / name), 3)
        back = spark.read.schema(table.schema).parquet(str(tmp_path / name))
        assert back.count() == table.count()


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op7_query(spark, tiny):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.op7_packing(spark, tiny).collect()
    by = defaultdict(dict)
    for r in got:
        by[r.doc_id][r.piece] = r
    for i, text in docs.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert sorted(by[i]) == list(range(-(-len(ids) // 2048)))
        for p, r in by[i].items():
            part = ids[2048 * p : 2048 * (p + 1)]
            assert (r.start, r.length, r.ids_crc32) == (2048 * p, len(part), zlib.crc32(part.tobytes()))
    assert check_packed(got, 2048) <= 1.03 * sum(r.length for r in got) / 2048 + 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abC é\n\t\r\x85　\x1c'sİK<|>0123.𝒳ﬁ")), max_size=60))
def test_op7_words_encode_like_texts(text):
    encoder = packing.WordEncoder(TOKENIZER)
    assert np.frombuffer(encoder.encode(text + " <|endoftext|> it's"), "<u4").tolist() == encoder.tokenizer.encode(text + " <|endoftext|> it's", add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_op7_best_fit_is_the_plain_one(lengths, limit):
    fit = packing.BestFit(20, limit)
    got = [fit.place(n) for n in lengths]
    open_bins, made = [], 0  # (free, opened at)
    used = {}
    for n, (seq, offset) in zip(lengths, got):
        fits = [f for f, _ in open_bins if f >= n]
        if fits:
            f = min(fits)
            assert 20 - used[seq] == f
            open_bins.remove((f, seq))
        else:
            if len(open_bins) >= limit:
                fullest = min(f for f, _ in open_bins)
                gone = next(b for b in reversed(open_bins) if b[0] == fullest)
                open_bins.remove(gone)
            assert seq == made
            made, f = made + 1, 20
        assert offset == 20 - f
        used[seq] = offset + n
        if f - n:
            open_bins.append((f - n, seq))


def test_op7_odd_rows(odd, nothing):
    got = packing.pack_documents(odd, TOKENIZER, keep_ids=True).collect()
    assert len({(r.doc_id, r.ids_crc32) for r in got}) >= 9 and check_packed(got, 2048) > 50
    assert sum(r.length == 1 for r in got) == 4 and all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack_documents(nothing, TOKENIZER).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.001, 5), min_size=1), st.integers(1, 400))
def test_op10_deviation_is_below_one_block(weights, n):
    """At every slot, of the exact weights, while all sources last."""
    total = sum(Fraction(w) for w in weights.values())
    done = Counter()
    for at, (source, block, slot, release, deadline) in enumerate(mixing.pfair_schedule(weights, dict.fromkeys(weights, n))):
        assert release <= slot < deadline and block == done[source] and slot == at
        assert release == math.floor(block * total / Fraction(weights[source])) and deadline == math.ceil((block + 1) * total / Fraction(weights[source]))
        done[source] += 1
        assert all(abs(done[s] - Fraction(w) / total * (slot + 1)) < 1 for s, w in weights.items())
        if done[source] == n:
            break


def test_op10_sources_that_run_out():
    got = list(mixing.pfair_schedule({"a": 1, "b": 3, "c": 1e-9}, {"a": 2, "b": 1, "c": 2}))
    assert [x[:3] for x in got if x[0] != "c"] == [("b", 0, 0), ("a", 0, 2), ("a", 1, 4)] or sorted(x[:2] for x in got if x[0] != "c") == [("a", 0), ("a", 1), ("b", 0)]
    assert all(release <= slot < deadline for _, _, slot, release, deadline in got) and [x[1] for x in got if x[0] == "c"] == [0, 1]
    assert list(mixing.pfair_schedule({}, {})) == []


def test_op10_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = queries.op10_mixing(spark, tiny).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert len({(r.mix_slot, r.mix_offset) for r in got}) == len(got)
    counts = Counter(r.source for r in got)
    blocks = {s: -(-n // 16) for s, n in counts.items()}
    want = {(s, i): slot for s, i, slot, _, _ in mixing.pfair_schedule({s: n**0.5 for s, n in counts.items()}, blocks)}
    assert all(want[r.source, r.mix_block] == r.mix_slot for r in got)
    sizes = Counter((r.source, r.mix_block) for r in got)
    assert all(sizes[s, i] == min(16, counts[s] - 16 * i) for s, i in want)


def test_op10_order_in_files(spark, tmp_path):
    rows = [(i, f"t{i % 90}", "a" if i % 2 else ("b" if i % 4 else None)) for i in range(700)] + [(1, "same", "a")] * 200
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(str(tmp_path / "in"))
    for df in (spark.read.parquet(str(tmp_path / "in")), spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)):
        places = mixing.mix_sources(df, {"a": 3, "b": 1}, block_rows=5, rows_per_bucket=30).orderBy("mix_slot", "mix_offset").collect()
        first = Counter(r.source for r in places[:200])
        assert len(places) == 900 and abs(first["a"] - 150) < 10 and first[None] == 0 and all(r.source is None for r in places[-100:])
        files = mixing.in_mixed_order(df, {"a": 3, "b": 1}, block_rows=5, rows_per_bucket=30, rows_per_file=70)
        assert files.columns == df.columns and [r.doc_id for r in files.collect()] == [r.doc_id for r in places]
        told = mixing.in_mixed_order(df, {"a": 3, "b": 1}, block_rows=5, rows_per_file=50, keep_places=True).collect()
        assert [(r.source, r.mix_block, r.mix_slot, r.mix_offset) for r in told] == [(r.source, r.mix_block, r.mix_slot, r.mix_offset) for r in places]


def test_op10_odd_rows(odd, nothing):
    assert mixing.mix_sources(odd).count() == 11 and mixing.mix_sources(nothing).count() == 0
    for table in (odd, nothing, odd.withColumn("mix_slot", F.lit(3))):
        out = mixing.in_mixed_order(table)
        assert out.columns == table.columns and sorted(map(repr, out.collect())) == sorted(map(repr, table.collect()))
