"""The operators on Spark: small tables with nulls, empties, ties, repeats and clashing columns, against plain versions."""

import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import bpe, embed_dedup, html_extract, lm, mixing, quality, simhash, topk, toxicity, url_filter
from skyloom.llm import queries as Q
from skyloom.llm.common import components, is_fold, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, t string, row int, fp long, k int, p int"


def docs(spark, texts, sources=None):
    rows = [(i, t, None, sources[j] if sources else None, 0, 9.0, "x", 1, 2, 3, 4) for j, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [(1, "A b c d e"), (2, None), (3, ""), (None, "a B c d e"), (5, "word " * 20_000), (6, " \t\n"), (1, "A b c d e"), (8, "x" * 70_000)]


def test_bpe_rows(spark):
    out = bpe.encode_documents(docs(spark, AWKWARD), *Q.tokenizer()).collect()
    assert len(out) == 8
    c = bpe.codec(*Q.tokenizer())
    for t in ("A b c d e", "", "word " * 20_000):
        ids = c.encode(t)
        assert any(r.n_tokens == len(ids) and bytes(r.ids) == ids.tobytes() for r in out)
    assert bpe.encode_documents(docs(spark, []), *Q.tokenizer()).count() == 0


def test_simhash_groups(spark):
    base = [f"w{i}" for i in range(300)]
    near = [" ".join([*base[:k], "zz", *base[k + 1 :]]) for k in range(0, 300, 10)]
    texts = [*AWKWARD, *[(100 + i, t) for i, t in enumerate([" ".join(base), *near])]]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()]
    fps = [simhash.fingerprint((t or "").encode()) for _, t in texts]
    ids = [i for i, _ in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for a in range(len(texts)):
        least.setdefault(find(a), []).append(ids[a])
    want = [(ids[a], f"{fps[a]:016x}", min(x for x in least[find(a)] if x is not None)) for a in range(len(texts))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_splits_large_buckets(spark):
    fps = [(x | 5 << 40,) for x in range(0, 1200)] + [(1 << 62 | x << 20,) for x in range(0, 3000, 7)]
    d = spark.createDataFrame(fps, "fp long")
    edges = simhash.links(d, large=16)
    got = {r.node: r.component for r in components(edges).collect()}
    values = sorted({f for f, in fps})
    want = {v: v for v in values}
    changed = True
    arr = np.array(values, np.int64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2
    label = np.arange(len(arr))
    while changed:
        new = np.array([label[near[i]].min() for i in range(len(arr))])
        changed = (new != label).any()
        label = new
    for i, v in enumerate(values):
        assert got.get(v, v) == values[label[i]], v
    assert want


def check_mix(spark, texts, sources, **options):
    """The mix as pandas, held against its rules: sizes, targets, whole blocks dealt by the tree's quotas, words near the target."""
    mixed = mixing.mix(docs(spark, texts, sources), **options).cache()
    out, drawn = mixed.toPandas(), mixing.copies(mixed).toPandas()
    size = Counter(len((t or "").encode().split()) for _, t in texts)
    assert Counter(out["size"]) == size and len(drawn) == out.times.sum() and (out.taken == out.times * out["size"]).all()
    by_source = Counter()
    for (_, t), s in zip(texts, sources):
        by_source[s] += len((t or "").encode().split())
    want = mixing.targets(list(by_source.items()), [1, 2, 3])
    blocks = {}
    for j, (s, n) in enumerate(sorted(by_source.items(), key=lambda x: (x[0] is None, x[0] or ""))):
        g = out[out.source.isna() if s is None else out.source == s]
        left = int(want[s]) - g.taken.sum()
        assert (g.source_size == n).all() and np.allclose(g.target, float(want[s])) and g.times.max() <= 3
        base = int(want[s] // n) if n else 0
        free = g[(g["size"] > 0) & (g.times == base)]["size"]
        assert g[g["size"] > 0].times.isin([base, base + 1]).all()
        if n and want[s] < 3 * n:  # neither one document more nor the longest less comes nearer
            longest = g[(g["size"] > 0) & (g.times > base)]["size"].max()
            assert all(abs(left - f) >= abs(left) - 1e-6 for f in free) and not abs(left + longest) < abs(left), (s, left)
        d = drawn[drawn.source.isna() if s is None else drawn.source == s]
        last = d[d["copy"] == base]
        assert (d.groupby(["copy", "block"]).shard.nunique() == 1).all()  # a block is drawn whole, by one shard
        blocks[j] = base, sorted(set(g.block)), sorted(set(last.block))
        in_pass = d.groupby(["copy", "block"]).shard.first().sort_index()
        assert in_pass.is_monotonic_increasing  # the next blocks of the permutation
    quota = np.array([b * len(own) + len(last) for b, own, last in blocks.values()])
    parts = mixing.split_quota(quota, options.get("shards", 16), np.random.default_rng(options.get("seed", 7)))
    for j, s in enumerate(sorted(by_source, key=lambda x: (x is None, x or ""))):
        d = drawn[drawn.source.isna() if s is None else drawn.source == s]
        got = d.drop_duplicates(["copy", "block"]).groupby("shard").size()
        assert [int(got.get(k, 0)) for k in range(len(parts))] == parts[:, j].tolist()
    return out


def test_mixing(spark):
    r = np.random.default_rng(0)
    texts = [(i, "w " * int(r.integers(0, 60))) for i in range(2000)] + [(None, None), (7, "w w w")]
    sources = [("a", "b", None, "c")[i % 4] if i % 3 else "a" for i in range(2002)]
    a, b = (check_mix(spark, texts, sources) for _ in range(2))
    for x in (a, b):
        x["at"] = x.shards.map(str) + x.orders.map(str)
    cols = ["doc_id", "size", "taken", "block", "at"]
    assert a.sort_values(cols)[cols].reset_index(drop=True).equals(b.sort_values(cols)[cols].reset_index(drop=True))
    for _, g in a.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2
    assert abs(a.groupby("source", dropna=False).target.first().sum() - a["size"].sum()) < 1e-6
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None), (2, "")])).toPandas().taken.sum() == 0


HARD = {
    "mostly empty": [(i, "w " * 100 if i % 40 == 0 else "") for i in range(1600)],
    "very long": [(i, "w " * 30_000 if i % 20 == 0 else "w " * (10 + i % 7)) for i in range(1600)],
    "one id": [(5, "w " * (1 + i % 9)) for i in range(1600)],
    "one row": [(5, "w w w")] * 1600,
    "null ids": [(None, "w " * (i % 50)) for i in range(1600)],
    "long and short": [(i, "w " * 50_000 if i == 3 else "w " * 5) for i in range(1600)],
}


@pytest.mark.parametrize("case", HARD)
def test_mixing_of_hard_tables(spark, case):
    check_mix(spark, HARD[case], [("a", "b", "c")[i % 3] if i % 2 else "a" for i in range(1600)])


def test_mixing_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 2)
    check_mix(spark, [(i, "w " * (i % 13)) for i in range(1500)], [f"s{i % 200}" if i % 3 else "s0" for i in range(1500)], shards=5)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, [(1, "a"), (2, "b"), (3, "c")], ["a", "b", "c"]))


@pytest.mark.parametrize("hubs", [False, True])
def test_lm_equals_plain_counts(spark, monkeypatch, hubs):
    if hubs:  # 70 batches ask through two layers of hubs
        monkeypatch.setattr(lm, "FAN", 4)
        monkeypatch.setattr(lm, "LAST", 8)
        monkeypatch.setattr(lm, "BATCH_BYTES", 8000)
    texts = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i % 9))) for i in range(40)] + AWKWARD + [(90, "UP up unknownword")] + [(33, "one row many times")] * 10_000 * (not hubs)
    got = lm.score_documents(docs(spark, texts), ~is_fold(F.col("doc_id"), 7, 2)).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    learn = [t for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c, c2 = Counter(), Counter()
    for t in learn:
        w = tokens(t)
        c.update(w)
        c2.update(zip([b"", *w], w))
    n, v = sum(c.values()), len(c)
    single = lambda w: (c[w] - 0.5) / n if c[w] else 0.5 * v / n
    want = []
    for i, t in texts:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((c2[u, x] + 50 * single(x)) / (c[u] + 50)) for u, x in zip([b"", *w], w))
        want.append((str(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    # the distribution over all words and the unknown one sums to one
    u = b"w1"
    assert abs(sum((c2[u, x] + 50 * single(x)) / (c[u] + 50) for x in c) + 50 * single(b"?") / (c[u] + 50) - 1) < 1e-9
    texts = texts[:50]
    nothing = lm.score_documents(docs(spark, texts), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in nothing)
    assert lm.score_documents(docs(spark, []), F.lit(True)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, v int, l int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS)


BROKEN = [(900, None, 1), (901, [], 1), (902, [float("nan"), 1.0, 0.0], 1), (903, [None, 1.0, 0.0], 1), (904, [0.0, 0.0, 0.0], 1), (905, [1.0, 0.0, 0.0], None), (906, [float("inf"), 0.0, 0.0], 1)]


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(120, 3)).astype(np.float32)
    x[10:20] = x[10]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(120)]
    d = vectors(spark, rows + BROKEN)
    got = {tuple(t) for t in topk.top_k(d, d.where("vec_id % 50 = 0")).collect()}
    data = {i: np.floor(256 * np.array(v, np.float64)) for i, v, _ in [*rows, BROKEN[4], BROKEN[5]]}
    want = set()
    for q in (0, 50, 100):
        best = sorted((-int(data[q] @ data[j]), j) for j in data if j != q)[:5]
        want |= {(q, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert got == want
    assert topk.top_k(d.limit(0), d.limit(0)).count() == 0
    assert topk.top_k(d.where("vec_id = 0"), d.where("vec_id = 0")).count() == 0


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (5, [0.99, 0.01, 0.0], 0), (5, [0.99, 0.0, 0.02], 0), (5, [0.0, 0.0, 1.0], 0), (7, [0.0, 0.0, 1.0], 0), (7, [0.0, 0.0, 1.0], 0)]
    d = vectors(spark, rows)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(d).collect())
    assert got == [(1, 2, 1, True), (5, 2, 1, False), (5, 2, 1, False), (5, 2, 5, True), (7, 2, 5, False), (7, 2, 5, False)]
    top = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(d, d.where("vec_id = 1")).collect())
    assert top == [(1, 1, 5, 256 * 253), (1, 2, 5, 0), (1, 3, 7, 0)]


@pytest.mark.parametrize("tile", [16, 1024])
def test_embedding_groups_equal_brute_force(spark, tile):
    r = np.random.default_rng(1)
    x = (np.repeat(r.normal(size=(12, 3)), 8, 0) + r.normal(size=(96, 3)) * 0.2).astype(np.float32)
    x[5:15] = x[5]
    rows = [(i, [float(v) for v in x[i]], i % 2) for i in range(96)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(vectors(spark, rows + BROKEN), tile=tile).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    lab = np.arange(96) % 2
    m = (u @ u.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(m, False)
    label = np.arange(96)
    for _ in range(96):
        label = np.array([min(label[i], label[m[i]].min(initial=99)) for i in range(96)])
    assert all(got[i] == (m[i].sum(), label[i], label[i] == i) for i in range(96))
    assert all(got[i] == (0, i, True) for i, _, _ in BROKEN)
    assert embed_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_url_rules_and_aliases(spark):
    pages = [
        (1, "http://A.Example.com/en/x?q#f", None), (2, "https://www.example.com/en/", ""), (3, None, None), (4, "no scheme", "<p>"),
        (5, "http://x.org/a", '<link rel="canonical" href="http://y.net/es/b">'), (6, "http://x.org/c", "<meta http-equiv='refresh' content='0; url=/a'>"),
        (7, "http://z.org/", "<link href=http://y.net/fr/1 rel=canonical><link rel='canonical' href='http://q.com/'>"), (8, "http://notexample.org", "<link rel=stylesheet href=http://y.net/es/b>"),
        (10, "http://x.org/d", "<LINK REL='alternate Canonical' HREF=' http://y.net/es/?a&amp;b '>"),
        (9, "net://://x", None), (1, "http://A.Example.com/en/x?q#f", None), (None, "http://a.net/de/", None),
    ]
    d = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, rule string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(d, Q.RULES).collect()}
    assert got == {
        (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "x.org", "/a", None, "block"), (6, "x.org", "/c", None, "block"), (7, "z.org", "/", None, "allow"), (8, "notexample.org", "", None, "allow"), (9, ":", "//x", None, "allow"), (10, "x.org", "/d", None, "block"), (None, "a.net", "/de/", None, "allow"),
    }
    plain = url_filter.judge(d, [], html=None)
    assert plain.count() == 12 and url_filter.judge(d.limit(0), Q.RULES).count() == 0 and {r.verdict for r in plain.collect()} == {"allow"}


def test_url_plan_is_native(spark, sf):
    plan = Q.op9_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_html_rows(spark):
    d = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<article><p>Hi there.</article>", "y"), (2, "u", "", "z")], "page_id long, url string, html string, text string")
    want = [("1", "", 0), ("2", "", 0), ("None", "Hi there.", 9)]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_extract.extract(d).collect()) == want
    assert html_extract.extract(d.union(d)).count() == 6 and html_extract.extract(d.limit(0)).count() == 0


def test_classifiers_without_labels(spark):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs(spark, AWKWARD)
    assert {r.score for r in quality.score_quality(d, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.score_toxicity(d, none).collect()} == {0}
    one = spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.score_quality(d, one).collect()} == {1}
    carried = toxicity.score_toxicity(d, one, carry=True).select("row.*", "score")
    assert carried.count() == 8 and "row" in carried.columns


def test_toxicity_learns_from_all_windows(spark, monkeypatch):
    r = np.random.default_rng(5)
    bad = [f"vile{c}curse" for c in "abcdefghij"]
    texts, labels, seen = [], [], []
    for i in range(60):
        words = [f"plain{r.integers(1e9)}" for _ in range(4000)]
        texts.append((i, " ".join([*words, *(bad if i % 2 else [])])))
        labels.append((i, i % 2))
    whole, plain = toxicity.train, toxicity.calibrate
    monkeypatch.setattr(toxicity, "train", lambda bags: seen.extend(len(pickle.loads(b)) for _, b in bags) or whole(bags))
    monkeypatch.setattr(toxicity, "calibrate", lambda g, held, shares: seen.append(held) or plain(g, held, shares))
    out = toxicity.score_toxicity(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = seen.pop()
    assert len(seen) == 40 and min(seen) > 3900
    assert len(held) == 20 and all(min(x[:3]) > 0 for y, x in held if y)
    assert all(x.predicted == x.doc_id % 2 for x in out)


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.9), ("op5_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    out = Q.QUERIES[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out[label]).mean() >= least
    hits = out[out[label] == 1]
    assert hits.predicted.mean() >= 0.7


def _jaccard_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("large", [64, 3])
def test_near_copies_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    change = lambda k: " ".join(f"x{r.integers(1e9)}" if i in set(r.choice(150, k, replace=False)) else w for i, w in enumerate(base))
    texts = [" ".join(base), *[change(int(k)) for k in r.integers(1, 5, 60)], "a b c d e f", "A b  c d e f", "a b", "b a", None, ""]
    texts += [" ".join([f"u{j}-{i}" for i in range(20)] + base[:15]) for j in range(40)]
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs(spark, list(enumerate(texts)))).collect()}
    want = _jaccard_groups(texts)
    assert len(set(want)) > 45 and [got[i] for i in range(len(texts))] == want
