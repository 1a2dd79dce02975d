"""Near-dedup, toxicity, language model, pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from lipikar.llm import components, katz, neardup, queries, secrets, toxicity, words
from lipikar.llm.common import remainder


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def same_classes(a, b):
    """Whether two labellings group alike."""
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_op5_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(n, n + 1) for n in range(300, 340)] + [(400, n) for n in range(401, 460)]
    df = spark.createDataFrame(links, "a int, b int").repartition(4)
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    want = roots(460, links)
    least = {}
    for n, r in enumerate(want):
        least.setdefault(r, n)
    for n in {x for l in links for x in l if l[0] != l[1]}:
        assert got[n] == least[want[n]]


def near_texts():
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(3000)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(150, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    return texts + ["", None, "", "one two", "one two", "One, two!", "three"]


def test_op5_against_all_pairs(spark):
    texts = near_texts()
    params = neardup.NearDupParams()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    idf = neardup.document_frequencies(df, "text", params)
    shingler = words.Shingler(5)
    sets = [neardup.weighted_set(shingler, t or "", idf) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (texts[i] or "") == (texts[j] or "") or neardup.weighted_jaccard(sets[i], sets[j]) >= 0.8]
    want = roots(len(texts), links)
    got = {r.doc_id: r for r in neardup.near_duplicate_classes(df).collect()}
    assert len(got) == len(texts) and same_classes(want, [got[i].class_id for i in range(len(texts))])
    assert all(got[i].class_id == min(j for j in got if got[j].class_id == got[i].class_id) and got[i].class_size == want.count(want[i]) for i in got)
    kept = sorted(r.doc_id for r in neardup.deduplicate(df).collect())
    assert kept == sorted({r.class_id for r in got.values()})


def test_op5_twins_in_a_group_of_many_classes(spark):
    """Texts of one template share bands without being alike; twins among them are found though no leader stands near."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(100_000)}"
    template = [word() for _ in range(150)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(50)]
        texts += [" ".join([*template, *own]), " ".join([*template, *own[:-1], word()])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    params = neardup.NearDupParams(bands=1, rows=1)
    idf = spark.sparkContext.broadcast(cloudpickle.dumps(neardup.document_frequencies(df, "text", params)))
    band = {bytes(r.node): r.bands[0] for r in neardup.signatures(df, "text", idf, params).collect()}
    of = [band[hashlib.md5(t.encode()).digest()] for t in texts]
    together = [i for i in range(0, len(texts), 2) if of[i] == of[i + 1] and of.count(of[i]) > 8]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(df, neardup.NearDupParams(bands=1, rows=1, block=7)).collect()}
    assert len(together) > 8 and all(got[i + 1] == i for i in together) and all(c in (i, i - i % 2) for i, c in got.items())


def test_op5_spanning_links():
    rng = random.Random(9)
    for _ in range(20):
        n = rng.randrange(2, 30)
        ids = [np.array(sorted(rng.sample(range(14), rng.randrange(1, 12))), np.uint64) for _ in range(n)]
        weights = [np.array([1.0 + int(i) % 3 for i in x]) * rng.choice([1, 1, 2]) for x in ids]
        classes = np.array([rng.randrange(12) for _ in range(n)])
        alike = lambda i, j: neardup.weighted_jaccard((ids[i], weights[i]), (ids[j], weights[j]))
        want = [(i, j) for i in range(n) for j in range(i) if classes[i] != classes[j] and alike(i, j) >= 0.6]
        got = neardup.spanning_links(ids, weights, classes, 0.6)
        assert len(got) < n and all(math.isclose(s, alike(i, j)) and s >= 0.6 and classes[i] != classes[j] for i, j, s in got)
        same = [(i, j) for i in range(n) for j in range(i) if classes[i] == classes[j]]
        assert same_classes(roots(n, want + same), roots(n, [(i, j) for i, j, _ in got] + same))


def test_op5_samples_estimate_similarity():
    rng = np.random.RandomState(2)
    for n in (900, 26_000):
        ids = np.unique(rng.randint(0, 2**48, n)).astype(np.uint64)
        w = rng.uniform(0.7, 10.4, len(ids))
        a, b = slice(0, len(ids) * 7 // 9), slice(len(ids) * 150 // 900, len(ids) * 850 // 900)
        sampler = neardup.WeightedSampler(1500, 1)
        s = sampler(np.concatenate([ids[a], ids[b]]), np.concatenate([w[a], w[b]]), np.array([0, len(ids[a])]))
        exact = neardup.weighted_jaccard((ids[a], w[a]), (ids[b], w[b]))
        assert abs((s[0] == s[1]).mean() - exact) < 0.045


def test_op5_shingles_are_plain_ones():
    """Texts share a shingle's number where, and only where, they share five words in a row."""
    texts = ["", "one two", "One, TWO!", "a b c d e f a b c d e", "x a B c_d É12 ß f g h", "c_d é12 ß f g h i", "!?", "q " * 9]
    plain = []
    for t in texts:
        w = re.findall(r"\w+", t.lower())
        plain.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    ids, tf, starts, of = words.Shingler(5).sets(texts)
    ends = [*starts[1:], len(ids)]
    got = {int(o): dict(zip(ids[a:b].tolist(), tf[a:b].tolist())) for o, a, b in zip(of, starts, ends)}
    assert set(got) == {i for i, p in enumerate(plain) if p}
    for i, p in enumerate(plain):
        if p:
            assert sorted(p.values()) == sorted(got[i].values())
            alone = words.Shingler(5).one(texts[i])
            assert dict(zip(alone[0].tolist(), alone[1].tolist())) == got[i]
    for i in got:
        for j in got:
            assert len(set(got[i]) & set(got[j])) == len(set(plain[i]) & set(plain[j]))
    a = np.array([1, 2, 2**48 - 1], np.uint64)
    assert words.unpack_ids(words.pack_ids(a)).tolist() == a.tolist()
    assert words.unpack_counts(words.pack_counts(np.array([1, 7, 1])), 3).tolist() == [1, 7, 1]


def test_op5_weights_are_inverse_document_frequencies(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(5))
    texts = [f"{word()} {word()} {word()} {word()} {word()} | {passage} | {word()}" if i % 10 == 0 else " ".join(word() for _ in range(20)) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    params = neardup.NearDupParams()
    idf = neardup.document_frequencies(df, "text", params)
    own, _ = words.Shingler(5).one(passage)
    assert abs(float(idf(own)[0]) - math.log1p(600 / 60)) < 0.15
    rare, _ = words.Shingler(5).one(texts[1])
    assert np.median(idf(rare)) > 0.9 * math.log1p(600)
    # a group of copies counts as one document: its shingles weigh nearly as much as rare ones
    copies = df.union(spark.range(300).selectExpr("id + 1000 as doc_id", f"'{texts[1]}' as text"))
    assert np.median(neardup.document_frequencies(copies, "text", params)(rare)) > 0.9 * math.log1p(600)


def test_op5_recall_by_similarity(spark):
    """Pairs in each band of weighted similarity that end in one class; banding may miss 0.2 % at the threshold."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**5)}"
    texts = []
    for _ in range(500):
        base = [word() for _ in range(rng.randrange(80, 300))]
        other = list(base)
        for _ in range(max(1, int(len(base) * rng.uniform(0.002, 0.03)))):
            other[rng.randrange(len(other))] = word()
        texts += [" ".join(base), " ".join(other)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    idf, shingler = neardup.document_frequencies(df, "text", neardup.NearDupParams()), words.Shingler(5)
    sets = [neardup.weighted_set(shingler, t, idf) for t in texts]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(df).collect()}
    found = defaultdict(list)
    for i in range(0, len(texts), 2):
        s = neardup.weighted_jaccard(sets[i], sets[i + 1])
        found[min(9, int(s * 10))].append(got[i] == got[i + 1])
    assert len(found[8]) > 40 and np.mean(found[8]) >= 0.97 and np.mean(found[9]) >= 0.99
    assert not any(found[k][n] for k in found if k < 8 for n in range(len(found[k])))


def test_op5_odd_rows(odd, nothing):
    got = neardup.near_duplicate_classes(odd).collect()
    assert len(got) == 11
    by = defaultdict(list)
    for r in got:
        by[r.class_id].append(r.class_size)
    assert by[1] == [3, 3, 3, 1] or sorted(by[1]) == [1, 3, 3, 3]
    kept = neardup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len({bytes(r.node) for r in got})
    assert neardup.near_duplicate_classes(nothing).count() == 0 and neardup.deduplicate(nothing).count() == 0


def test_op6_index_is_exact():
    rng = random.Random(4)
    for n in (0, 3, 700):
        vectors = []
        for _ in range(n):
            terms = sorted(rng.sample(range(40), rng.randrange(0, 6)))
            vectors.append((np.array(terms, np.uint64), np.array([rng.choice([0.25, 0.5, rng.random()]) for _ in terms])))
        index = toxicity.BlockMaxIndex(vectors)
        for turn in range(40):
            terms = sorted(rng.sample(range(45), 4))
            q = {t: rng.random() for t in terms}
            scores = sorted((-sum(q.get(t, 0) * w for t, w in zip(v[0].tolist(), v[1])), i) for i, v in enumerate(vectors) if i != turn)
            want = [(i, -s) for s, i in scores if s < 0][:7]
            got = index.nearest((np.array(terms, np.uint64), np.array([q[t] for t in terms])), 7, without=turn if turn < n else -1)
            assert np.allclose([s for _, s in got], [s for _, s in want])
            assert {i for i, s in got if s > got[-1][1] + 1e-12} == {i for i, s in want if s > want[-1][1] + 1e-12} if want else got == []


def test_op6_against_plain_cosines(spark):
    """The query's neighbours from dictionaries of words: no index, hashes or packed arrays."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    bags = {i: Counter(re.findall(r"\w+", t.lower())) for i, t in docs.items()}
    df = Counter(w for b in bags.values() for w in b)
    first, toxic, clean = {}, Counter(), Counter()
    for i in sorted(truth):
        if i in docs:
            first.setdefault((truth[i], tuple(sorted(bags[i].items()))), i)
    examples = sorted(first.values())
    for i in examples:
        (toxic if truth[i] else clean).update(set(bags[i]))
    n = Counter(truth[i] for i in examples)

    def weight(w, c):
        out = (1 + math.log(c)) * (math.log1p(len(docs) / df[w]) - math.log(2))
        ratio = toxic[w] * math.log((toxic[w] + 0.5) / n[1] / ((clean[w] + 0.5) / n[0]))
        return out * (1 + ratio**0.75 if toxic[w] >= 3 and ratio > 0 else 1)

    def vector(bag):
        v = {w: weight(w, c) for w, c in bag.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    vectors = {i: vector(bags[i]) for i in docs}
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(remainder(F.col("doc_id"), 3) != 1)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    got = toxicity.score_toxicity(frame, toxicity.fit_toxicity(frame, labels)).collect()
    with_evidence = 0
    for r in got:
        cosines = sorted((sum(x * vectors[e].get(w, 0.0) for w, x in vectors[r.doc_id].items()) for e in examples), reverse=True)
        want = [c for c in cosines if c > 0][:3]
        assert np.allclose([e.cosine for e in r.toxic_evidence], want, rtol=0.03, atol=1e-3)
        with_evidence += len(want) > 0
    assert with_evidence > 0.97 * len(got) and len({r.toxic_score for r in got}) > 4


def test_op6_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op6_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    toxic, clean = [r for r in held if truth[r.doc_id]], [r for r in held if not truth[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_op6_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    got = toxicity.score_toxicity(odd, model)
    assert got.count() == 11 and got.filter("toxic_score is null").count() == 0
    for docs, given in ((nothing, labels), (odd, labels.limit(0)), (odd, labels.filter("toxic = 0"))):
        assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, given)).count() == docs.count()


def brute_ratios(counts, k=5):
    """Katz's discount ratios from a counter of n-grams; where the raw ones don't lie between 0 and 1, from a line through the logarithms."""
    n = {r: float(sum(c == r for c in counts.values())) for r in range(1, k + 2)}

    def ratios(n):
        if not n[1]:
            return None
        cut = (k + 1) * n[k + 1] / n[1]
        if cut >= 1 or not all(n[r] for r in range(1, k + 1)):
            return None
        return [((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) for r in range(1, k + 1)]

    raw = ratios(n)
    if raw and all(0 < d < 1 for d in raw):
        return raw
    seen = [r for r in n if n[r]]
    weight = sum(n[r] for r in seen)
    mx, my = (sum(n[r] * f(r) for r in seen) / weight for f in (math.log, lambda r: math.log(n[r])))
    slope = sum(n[r] * (math.log(r) - mx) * (math.log(n[r]) - my) for r in seen) / sum(n[r] * (math.log(r) - mx) ** 2 for r in seen) if len(seen) > 1 else -2.0
    slope = min(slope, -1.01)
    return ratios({r: math.exp(my + slope * (math.log(r) - mx)) for r in n})


def brute_katz(docs, order, k=5):
    """(tokens of each text, word counts, N, P(word | context)) from plain dictionaries; shares nothing with the operator."""
    tok = {i: [*t.encode().lower().split(), "END"] for i, t in docs.items()}
    train = [i for i in docs if zlib.crc32(str(i).encode()) % 10]
    grams = [Counter() for _ in range(order + 1)]
    for i in train:
        padded = ["END"] * (order - 1) + tok[i]
        for at in range(order - 1, len(padded)):
            for n in range(1, order + 1):
                grams[n][tuple(padded[at - n + 1 : at + 1])] += 1
    ratio = [None] + [brute_ratios(grams[n], k) for n in range(1, order + 1)]
    kept = lambda n, c: c * ratio[n][c - 1] if c <= k else float(c)
    total = sum(grams[1].values())
    free = sum(c - kept(1, c) for c in grams[1].values())
    size1 = total if free > 0 else total + 1
    after = [None, None] + [defaultdict(dict) for _ in range(2, order + 1)]
    for n in range(2, order + 1):
        for g, c in grams[n].items():
            after[n][g[:-1]][g[-1]] = c
    known = {}

    def p(context, w):
        if not context:
            c = grams[1][w,]
            return kept(1, c) / size1 if c else (free if free > 0 else 1.0) / size1
        follows = after[len(context) + 1].get(context)
        if not follows:
            return p(context[1:], w)
        if context not in known:
            n = len(context) + 1
            seen = sum(follows.values())
            left = sum(c - kept(n, c) for c in follows.values())
            size = seen if left > 1e-12 else seen + 1
            known[context] = size, (left if left > 1e-12 else 1.0) / size / (1 - sum(p(context[1:], x) for x in follows))
        size, weight = known[context]
        return kept(len(context) + 1, follows[w]) / size if w in follows else weight * p(context[1:], w)

    return tok, Counter({g[0]: c for g, c in grams[1].items()}), total, p


def test_op8_against_brute_force(spark, tiny):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{tiny}/documents.parquet")
    for order, params in ((3, katz.KatzParams(batch_tokens=20_000, hot=300, block=500)), (2, katz.KatzParams(order=2)), (4, katz.KatzParams(order=4, batch_tokens=30_000, hot=50))):
        tok, one, total, p = brute_katz(docs, order)
        for h in (("END",) * (order - 1), ("END", b"the")[: order - 1], (b"of", b"the")[: order - 1], tuple(next(t for t in tok.values() if len(t) > 9)[3 : 2 + order])):
            assert math.isclose(sum(p(h, w) for w in one) + p(h, "UNKNOWN"), 1.0, rel_tol=1e-9)
        got = katz.score_documents(frame, remainder(F.col("doc_id"), 10) == 0, params).collect()
        assert sorted(r.doc_id for r in got) == sorted(docs)
        for r in got:
            t = tok[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(one[w] > 0 for w in t), total)
            padded = ["END"] * (order - 1) + t
            want = sum(math.log10(p(tuple(padded[n : n + order - 1]), w)) for n, w in enumerate(t))
            assert math.isclose(r.score, want, rel_tol=1e-9), (order, r.doc_id, r.score, want)
            assert math.isclose(r.base_score, sum(math.log10((one[w] + 0.1) / (total + 0.1 * (len(one) + 1))) for w in t), rel_tol=1e-9)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op8_odd_rows(odd, nothing):
    for held in (F.col("doc_id") == 1, F.lit(True), F.lit(None).cast("boolean")):
        got = katz.score_documents(odd, held).collect()
        assert len(got) == 11 and sum(r.doc_id is None for r in got) == 2 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
        assert {r.n_tokens for r in got if r.doc_id in (2, 3, 6)} == {1}
    assert katz.score_documents(nothing, F.lit(False)).count() == 0


def test_op8_uneven_counts_are_smoothed():
    """Copies make n_5 large; the ratios are still Good-Turing's, for smoothed counts of counts."""
    n = [0, 1000, 300, 120, 100, 90, 20]
    raw, d = katz.Discounts.ratios(n, 5), katz.Discounts(n, 5)
    assert not all(0 < x < 1 for x in raw) and d.method == "simple good-turing"
    assert np.allclose(d.table[1:], katz.Discounts.ratios(katz.smoothed(n, 5), 5)) and all(0 < x < 1 for x in d.table[1:])
    even = [0, 1000, 300, 140, 80, 50, 34]
    assert katz.Discounts(even, 5).method == "good-turing" and np.allclose(katz.Discounts(even, 5).table[1:], katz.Discounts.ratios(even, 5))
    rng = random.Random(6)
    for _ in range(300):
        odd = [0, *(rng.choice([0, 1, 7, rng.randrange(10**6)]) for _ in range(6))]
        assert all(0 < x < 1 for x in katz.Discounts(odd, 5).table[1:])


def test_op8_pack_round_trip():
    for a in ([], [0], [1, 255], [70_000, 3], [2**40, 1, 2**63 + 5]):
        x = np.array(a, np.uint64)
        assert katz.unpack(katz.pack(x)).astype(np.uint64).tolist() == a


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    from lipikar.llm.common import stored

    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns
        now = stored(out, f"test-{name}")
        counts.append(now.count())
    # decisions, each worked out anew
    learned = spark.read.parquet(f"{sf}/labels.parquet").filter(remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.fit_toxicity(docs, learned)
    mild = {r.doc_id: r.text for r in docs.collect() if model.score(*words.Shingler(1).one(r.text))[0] < 0.7}
    classes = neardup.near_duplicate_classes(docs.filter(F.col("doc_id").isin(list(mild)))).collect()
    kept = {r.class_id for r in classes}
    assert counts == [len(mild), len(kept), len(kept), len(kept)]
    got = now.collect()
    assert {r.doc_id for r in got} == kept and all(not secrets.Scanner().scan(r.text)[1] and r.n_chars == len(r.text) for r in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).orderBy("sequence_id", "offset")
    first = [r.doc_id for r in packed.filter("piece = 0").collect()]
    assert set(first) == kept
    place = {r.doc_id: n for n, r in enumerate(got)}
    assert np.corrcoef([place[i] for i in first], range(len(first)))[0, 1] > 0.3
    from lipikar.llm import common

    made = common.stored_so_far()
    assert corpus_pipeline.run(spark, sf).count() == packed.count()
    assert common.stored_so_far() - made <= 2  # what the last stage reads


def test_pipeline_stages_on_odd_rows(spark, odd, nothing):
    """Nulls, repeats, an empty table and extra columns that have the names of working columns."""
    sf = "/root/testdata/sf0.001"
    more = "toxic_score double, toxic_evidence string, mix_slot int, row_at long, kept_id int, sequence_id int"
    extra = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in more.split(", ")]
    for docs, n in ((odd.select("*", *extra), 11), (nothing.select("*", *extra), 0)):
        stages = dict(corpus_pipeline.STAGES)
        for name in ("toxicity", "secrets", "mixing"):
            out = stages[name](spark, docs, sf)
            assert out.columns == docs.columns and out.count() == n, name
        kept = stages["near_dedup"](spark, docs, sf)
        assert kept.columns == docs.columns and kept.count() == (7 if n else 0)
        packed = stages["packing"](spark, docs, sf)
        assert packed.filter("piece = 0").count() == n
