"""Fill-in-middle, licence scans and the prefix trie against plain versions, on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from skyloom.llm import fim, licenses, prefix_trie
from skyloom.llm import queries as Q

DOCS = "doc_id long, text string, n int, form string, output string, `key` int, bytes string, row int"
AWKWARD = [(1, "A b c d e"), (2, None), (3, ""), (None, "a B c d e"), (5, "word " * 20_000), (6, " \t\n"), (1, "A b c d e"), (8, "x" * 70_000), (9, "é ü\t漢字  "), (10, "say <P> now"), (11, " lead"), (12, "<P <S> M>"), (13, "a<P b<S c<M d>")]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "f", "o", 2, "b", 3) for i, t in texts], DOCS)


def plain_fim(doc_id, text):
    text = text or ""
    t = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in fim.MARKS) or h3 % 100 >= 50:
        return doc_id, len(t), "plain", None, None, text, text
    if h4 % 100 < 80:
        return doc_id, len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("chunk", [1, 3, 64, fim.CHUNK])
def test_fim_equals_plain(spark, chunk):
    rng = random.Random(chunk)
    texts = AWKWARD if chunk >= 64 else [x for x in AWKWARD if len(x[1] or "") < 100]
    texts = texts + [(100 + i, "".join(rng.choice(["a", "é", " ", "\n", "漢", "<", "P>", " ", "\u0085"]) for _ in range(rng.randrange(40)))) for i in range(150)]
    got = [tuple(r) for r in fim.transform(docs(spark, texts), chunk=chunk).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()]
    assert sorted(map(repr, got)) == sorted(repr(plain_fim(*x)) for x in texts)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}
    assert fim.transform(docs(spark, [])).count() == 0


def test_fim_does_not_shuffle(spark, sf):
    assert "Exchange" not in Q.op11_fim(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_fim_rates(spark):
    d = docs(spark, [(i, "one two three four") for i in range(400)])
    assert {r.form for r in fim.transform(d, plain_percent=0).collect()} == {"plain"}
    assert {r.form for r in fim.transform(d, plain_percent=100, spm_percent=0).collect()} == {"psm"}
    assert {r.prefix_chars for r in fim.transform(d, seed=1).collect()} - {None} <= {0, 3, 7, 13, 18}


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
    places = [i for i, _ in at]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def plain_labels(text):
    """Base and notice labels by a plain search for whole words."""
    line = f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', re.sub('[A-Z]', lambda m: m[0].lower(), text or '')))} "
    return {label for phrase, label in {**licenses.NOTICES, **licenses.BASE}.items() if f" {phrase} " in line}


LICENCES = [
    "Released under the MIT License. mit-license MIT\nLICENSE; submit license", "The Apache  license and the (GNU) General Public License!", "mit license mit license mit license",
    "// SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Apache-2.0)\nint x;", '{"license": "BSD-3-Clause"}', "License: see file", "license : mit and gpl and (", "éMIT license MIT licenseé ÀMIT LICENSE",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of it", "all rights reserved", "x mit licenses", "SPDX-License-Identifier: LicenseRef-Own", "Mit License " * 30_000,
]


def test_licenses_equal_plain(spark):
    texts = AWKWARD + [(200 + i, t) for i, t in enumerate(LICENCES)] + [(200, LICENCES[0])]
    words = ["mit", "MIT", "license", "License", "apache", "general", "public", "gnu", "é", "the"]
    rng = random.Random(7)
    texts += [(300 + i, rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(200)]
    got = licenses.scan(docs(spark, texts)).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(repr((i, *plain_base(t))) for i, t in texts)
    by_id = {r.doc_id: r for r in got}
    for i, t in texts:
        assert plain_labels(t) <= set(filter(None, by_id[i].labels.split(",")))
        assert 0 <= by_id[i].score <= 1 and (by_id[i].score > 0) == bool(by_id[i].labels)
    assert by_id[203].labels == "apache,gpl,mit" and by_id[203].score == 1.0
    assert by_id[204].labels == "bsd" and by_id[205].labels == "" and by_id[211].labels == "other"
    assert licenses.scan(docs(spark, [])).count() == 0
    carried = licenses.scan(docs(spark, texts), carry=True).first()
    assert carried.row.form == "f" and carried.row["n"] == 1


def plain_value(expression):
    """Recursive descent over the same grammar."""
    tokens = re.findall(r"[()]|[^\s()]+", expression)

    def chain(at, op, below):
        labels, freedom, at = below(at)
        while at < len(tokens) and tokens[at].lower() == op:
            more, other, at = below(at + 1)
            labels, freedom = labels | more, (min if op == "and" else max)(freedom, other)
        return labels, freedom, at

    def atom(at):
        if tokens[at] == "(":
            labels, freedom, at = either(at + 1)
            assert tokens[at] == ")"
            return labels, freedom, at + 1
        label = licenses.label_of(tokens[at])
        freedom, at = licenses.FREEDOM[label], at + 1
        if at < len(tokens) and tokens[at].lower() == "with":
            freedom, at = (max(freedom, licenses.EXCEPTED) if label in ("gpl", "agpl", "lgpl") else freedom), at + 2
        return frozenset({label}), freedom, at

    both = lambda at: chain(at, "and", atom)
    either = lambda at: chain(at, "or", both)
    labels, freedom, at = either(0)
    assert at == len(tokens)
    return labels, freedom


def expression(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        x = rng.choice(["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0+", "LGPL-2.1", "MPL-2.0", "CC-BY-SA-4.0", "Own"])
        return f"{x} WITH Classpath-exception-2.0" if rng.random() < 0.2 else x
    joined = f" {rng.choice(['AND', 'or', 'And', 'OR'])} ".join(expression(rng, depth - 1) for _ in range(rng.randrange(2, 4)))
    return f"({joined})" if rng.random() < 0.6 else joined


def test_shunting_yard_equals_recursive_descent():
    rng = random.Random(3)
    for _ in range(500):
        e = expression(rng, 4)
        assert licenses.evaluate(e) == plain_value(e), e
    assert licenses.evaluate("(" * 50_000 + "MIT" + ")" * 50_000) == (frozenset({"mit"}), 1.0)
    for bad in ["", "MIT OR", "OR MIT", "MIT Apache-2.0", "(MIT", "MIT)", "()", "(MIT OR ISC) WITH x", "MIT & GPL", "a with b with c"]:
        assert licenses.evaluate(bad) is None, bad
    assert licenses.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]


TURNS = "conv_id long, turn long, role string, text string, depth int, ka string, piece int, conv int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], TURNS)


def plain_trie(rows, group=5, heads=9):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = convs.get(c - (abs(c) % group) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    members = {}
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    below = {n: [m for m in members if m[: len(n)] == n] for n in members}
    childless = {n for n in members if len(below[n]) == 1}
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in m if len(rebuilt[c]) == len(n))
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in below[n] if u)
        kids = sum(len(u) == len(n) + 1 for u in below[n])
        out.append((m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids, sum(u in childless for u in below[n]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def assert_trie(spark, rows, **more):
    got = [tuple(r) for r in prefix_trie.trie(turns(spark, rows), **more).select(*COLS).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_trie(rows, **more)))


def test_trie_equals_plain(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é漢", None])) for c in range(-7, 60) for t in range(rng.randrange(6))]
    rows += [(70, None, "user", "a"), (70, None, "user", "b"), (70, 1, "user", "a"), (70, 1, "user", "a"), (70, 1, "us", "era"), (None, 0, "user", "lost"), (71, 0, "", "x" * 50_000)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 180) for t in range(12)]  # a group of copies
    assert_trie(spark, rows)


def test_trie_small_tables(spark):
    assert_trie(spark, [])
    assert_trie(spark, [(None, 1, "user", "a")])
    assert_trie(spark, [(3, 0, "user", "a")])  # what it opens with is absent
    assert_trie(spark, [(0, 0, "user", "a")] * 3)


def test_trie_chains_and_stretches(spark, monkeypatch):
    """Each conversation branches off the one before one turn later; and one conversation holds most rows."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    rows = [(c, t, "user", "a" if t < c else f"b{c}") for c in range(25) for t in range(c + 1)]
    rows += [(50, t, "user", "a") for t in range(300)]
    assert_trie(spark, rows, heads=1)
    assert_trie(spark, rows)


def test_end_list_over_runs(spark, monkeypatch):
    ids = list(itertools.chain(range(-50, 9000), range(20_000, 20_100)))
    d = spark.createDataFrame([(1, 2, 3, c) for c in reversed(ids)] + [(1, 2, 4, 7)], "ka long, kb long, depth long, conv long")
    got = {r.depth: r.ends_sha256 for r in prefix_trie.end_lists(d).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 4: hashlib.sha256(b"7").hexdigest()}


def test_near_copies_go_through_fingerprints(spark, monkeypatch):
    """The pipeline's near-copy groups start from SimHash links, and are those of all pairs of sets all the same (F6)."""
    import numpy as np

    from skyloom.llm import simhash

    r = np.random.default_rng(3)
    base = [[f"w{x}" for x in r.integers(0, 500, 120)] for _ in range(6)]
    texts = []
    for words in base:
        for swaps in (0, 0, 1, 3, 6, 12):
            w = list(words)
            for at in r.integers(0, 120, swaps):
                w[at] = f"z{r.integers(0, 1000)}"
            texts.append(" ".join(w))
    asked = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *a: asked.append(fps.count()) or links(fps, *a))
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert asked and asked[0] > 6
    sets = [set(simhash.shingles(t.encode(), 5, 42).tolist()) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            want[i] = min(want[j] for j, b in enumerate(sets) if 100 * len(a & b) >= 80 * len(a | b))
    assert got == dict(enumerate(want)) and 6 <= len(set(want)) < len(texts)
