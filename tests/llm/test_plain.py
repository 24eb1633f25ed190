"""The operators' inner parts against plain versions, without Spark."""

import html
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import bpe, embed_dedup, html_extract, mixing, quality, simhash, topk, toxicity

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.codec(PATH, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_merges(s):
    ids = CODEC.encode(s)
    assert list(ids) == TIKTOKEN.encode_ordinary(s)
    assert CODEC.decode(ids) == s.encode()


def test_bpe_of_dense_texts():
    r = random.Random(5)
    for alphabet in ("ab", "aeiou nrst", "0123456789", "äöüßéèñó abc", "!?#$ %", "日本語한국어", "\n\t  x", "it's we'll"):
        for _ in range(300):
            s = "".join(r.choice(alphabet) for _ in range(r.randint(1, 50)))
            assert list(CODEC.encode(s)) == TIKTOKEN.encode_ordinary(s)
    s = "".join(r.choice("abcdefgh") for _ in range(100_000))
    assert list(CODEC.encode(s)) == TIKTOKEN.encode_ordinary(s)


def test_bpe_needs_all_bytes():
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0}, "a")


def slow_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\n\t cDe", max_size=60))
def test_fingerprint(s):
    assert simhash.fingerprint(s.encode()) == slow_fingerprint(s)


def test_blocks_meet_every_close_pair():
    r = random.Random(1)
    for distance, blocks in ((2, 4), (2, 3), (3, 5)):
        masks = [simhash._mask(shared) % 2**64 for shared, _ in simhash._keys(list(range(64)), distance, blocks)]
        for _ in range(300):
            x = r.getrandbits(64)
            flips = sum(1 << b for b in r.sample(range(64), r.randint(0, distance)))
            assert any(x & m == (x ^ flips) & m for m in masks)


def test_bounds_hold_and_tiles_are_exact():
    r = np.random.default_rng(0)
    for scale in (1, 40):
        q, c = np.floor(r.normal(size=(9, 37)) * scale * 50), np.floor(r.normal(size=(300, 37)) * scale * 50)
        c[10:20] = c[10]
        for s in (1, 4, 16, 64):
            assert (topk.segment_profile(q, s) @ topk.segment_profile(c, s).T >= q @ c.T - 1e-6).all()
        ids = r.permutation(300)
        got = topk.top_of_tile(q, np.arange(1000, 1009), c, ids, 5)
        for i in range(9):
            want = sorted(zip(-(c @ q[i]), ids))[:5]
            assert [(v, s) for k, v, s in got if k == 1000 + i] == [(v, -s) for s, v in want]


def test_scores_beyond_doubles_are_exact():
    a = np.array([2.0**40, 3.0])
    assert topk._products(a, np.array([[2.0**20, 1.0], [2.0**40, 0.0]])) == [2**60 + 3, 2**63 - 1]


@pytest.mark.parametrize("seed", range(4))
def test_int8_bounds_lose_no_link(seed):
    r = np.random.default_rng(seed)
    x = np.repeat(r.normal(size=(20, 24)), 8, 0) + r.normal(size=(160, 24)) * r.choice([0.05, 0.3, 0.6], (160, 1))
    x *= 10.0 ** r.integers(-6, 6, (160, 1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = u @ u.T
    got = np.concatenate([m for _, m in embed_dedup.near_pairs(x, x, 0.93)])
    sure = np.abs(exact - 0.93) > 1e-12
    assert (got == (exact >= 0.93))[sure].all()


def test_targets_pour_over():
    t = mixing.targets([("b", 10), (None, 1000), ("a", 1000)], [1, 2, 3])
    assert t["b"] == 30 and sum(t.values()) == 2010
    assert t["a"] * 3 == t[None]  # weights 1 and 3
    assert mixing.targets([("x", 0)], [1])["x"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(1, 9))
def test_quota_tree_is_exact(quota, shards):
    q = np.array(quota, np.int64)
    d = mixing.split_quota(q, shards, np.random.default_rng(3))
    assert d.shape == (shards, len(q)) and (d.sum(0) == q).all() and d.min() >= 0
    assert d.sum(1).max() - d.sum(1).min() <= math.ceil(math.log2(shards + 1)) + 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy these things now at once.</div><!-- <p>no</p> -->
<article><h1>The   title</h1><p>One &amp; two&nbsp;words<br>go <b>on</b>.<p>Next.</p><div class="share-bar"><a href="/x">Share</a></div>
<section id="comments"><p>A reader said something long about all of this here.</p></section></article>
<aside><p>Read this other long text as well, it is good.</p></aside><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "The title\nOne & two words go on.\nNext."
    assert html_extract.main_text("") == "" == html_extract.main_text("<nav><a href=/>x</a></nav>")
    assert html_extract.main_text("<article><p>" + "a " * 50_000 + "</article>") == "a " * 49_999 + "a"
    assert html_extract.main_text("<article><p>open 'quote <b title='x>y'>z</b> a < b</article>") == "open 'quote z a < b"


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article><p>First a.</p><p><svg class="i"/> Second b.</p><p>Third c.</p></article>', "First a.\nSecond b.\nThird c."),
        ("<article><p>First a.</p><p><button>Go <p>Second b.</p><p>Third c.</p></article>", "First a.\nSecond b.\nThird c."),
        ("<article><p>x y<select><option>1<option>2<p>more here</p></article>", "x y\nmore here"),
        ("<article><p>a</p><video src=x><p>no video</p></video><p>b <button>press</button></p></article>", "a\nb"),
        ("<html><head><title>T</title><p>Some para here.</p><p>Another one with more words in it.</p>", "Some para here.\nAnother one with more words in it."),
        ("<title>abc<p>text here is long enough ok.", "text here is long enough ok."),
        ("<p>one</p>", "one"),
        ('<article><p>a b c</p><div class="notice-board-history"><p>It was long.</p></div><p class="notice">Accept</p></article>', "a b c\nIt was long."),
        ("<nav><ul><li><a href=/>x</a></ul><article><p>Text in an article.</p></article>", "Text in an article."),
        ("<form action=/><article><p>Text in an article.</p></article></form>", "Text in an article."),
        ('<article data-class="ad"><p data-id="comment">t<textarea>hid</textarea>u <math><mi>x</mi></math> v</p></article>', "t u v"),
        ("<!--> <article><p>a</p><!-- b --!><p>c</p></article>", "a\nc"),
    ],
)
def test_broken_markup_loses_no_text(page, text):
    assert html_extract.main_text(page) == text


def test_neighbours_decide_without_hints():
    link = '<div><a href="/">{}</a></div>'.format
    same = "<p>Nine words stand here in the same plain paragraph.</p>"
    prose = "<p>" + "word " * 40 + "</p>"
    assert html_extract.main_text(prose + same + prose) == "\n".join(["word " * 39 + "word", same[3:-4], "word " * 39 + "word"])
    assert html_extract.main_text(prose + link("a") + same.replace("Nine words stand here", "Nine") + link("b") + link("c")) == "word " * 39 + "word"


def test_tree_learns_its_pages():
    x, y = html_extract.labelled()
    assert (html_extract.tree().predict(x) == y.astype(bool)).all()
    used, todo = set(), [html_extract.tree()]
    while todo:
        node = todo.pop()
        if node.feature >= 0:
            used.add(html_extract.FEATURES[node.feature])
            todo += [node.low, node.high]
    assert {"words", "density", "words before", "density before", "words after", "density after"} <= used


def article(page):
    """The generated pages' article by plain cutting: blocks are h1 and p, b is mark-up, br a space."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    cut = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    return "\n".join(x for b in cut if (x := " ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split())))


def test_main_text_equals_the_article_of_generated_pages():
    for sf in ("sf0.001", "sf0.01"):
        for page in pq.read_table(f"/root/testdata/{sf}/pages.parquet")["html"].to_pylist():
            assert html_extract.main_text(page or "") == article(page or "")


def test_features_are_finite_for_any_bytes():
    for b in (b"", b"a", b"   ", bytes(range(256)), "né é".encode(), b"x" * 100_000):
        assert np.isfinite(quality.features(b)).all()


def test_windows_cut_long_tokens_whole():
    t = b"short " + b"x" * 200
    assert toxicity.windows(t) == [b"short"] + [b"x" * 64] * 5 + [b"x" * 40]  # every 32 bytes: no run is cut by all
    assert toxicity.Gauge(b"", b"").score(b"") == (0.0, 0, 0)


def test_lm_messages_grow_with_the_batches():
    from skyloom.llm import lm

    def messages(nodes, ranges=1):
        own = ranges * nodes * lm.parts_of(nodes, 1)
        return own if nodes <= lm.LAST else own + messages(-(-nodes // lm.FAN), ranges * lm.FAN)

    for batches in (10, 512, 5_000, 400_000, 12_500_000):  # the last is 100 TB
        assert messages(batches) <= 4 * 64 * batches  # of some 8 MB each; without hubs 12,500,000 would send 2e13


def test_lm_hubs_add_up_what_batches_count():
    from skyloom.llm import lm

    r = random.Random(7)
    texts = [[" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(50)).encode() for _ in range(3)] for _ in range(6)]
    batches = [lm.Batch(t, np.array([True, True, False])) for t in texts]
    asked = lm.pa.concat_tables([b.asks().messages(0, k, 0, 1) for k, b in enumerate(batches)])
    told = lm.tell(asked)
    for k, b in enumerate(batches):
        row = told.filter(lm.pa.array([n == k for n in told["node"].to_pylist()]))
        distinct, total, w, _ = lm._gathered(b.asks(), row, 0, 1)
        seen = [x for t in texts for d in t[:2] for x in [*d.lower().split(), b""]]
        assert total == len(seen) and distinct == len(set(seen))
        words = [b.words[i] for i in b.word_order]
        assert w.tolist() == [seen.count(x) for x in words]
