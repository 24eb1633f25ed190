"""The corpus operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import bpe, embed_dedup, fim, html_extract, licenses, lm, mixing, prefix_trie, quality, simhash, topk, toxicity, url_filter
from skyloom.llm.common import is_fold, table

RULES = [
    url_filter.Rule("allow", "com"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def learnable(labels: DataFrame) -> DataFrame:
    """The label rows outside the held-out fold."""
    return labels.where(~is_fold(F.col("doc_id"), 3, 1))


def held(scores: DataFrame, k: int, remainder: int) -> DataFrame:
    cols = [F.col("doc_id"), is_fold(F.col("doc_id"), k, remainder).alias("held_out")]
    return scores.select(*cols, *[c for c in scores.columns if c != "doc_id"])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return held(toxicity.score_toxicity(docs, learnable(labels)), 3, 1)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "times", "block", F.concat_ws(",", "shards").alias("shards"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return held(quality.score_quality(docs, learnable(labels)), 3, 1)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_documents(table(spark, sf_dir, "documents"), ~is_fold(F.col("doc_id"), 7, 2))
    scored = scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})  # the last bits vary with the order of sums
    return held(scored, 7, 2)


def tokenizer() -> tuple[str, str]:
    """Where the rank file lies, and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *tokenizer(), keep=False)


def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_mixing": op3_mixing,
    "op4_html": op4_html,
    "op5_quality": op5_quality,
    "op6_lm": op6_lm,
    "op7_bpe": op7_bpe,
    "op8_embed_dedup": op8_embed_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_fim": op11_fim,
    "op12_licenses": op12_licenses,
    "op13_prefix_trie": op13_prefix_trie,
}

USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
#: crc32 of a text of ASCII characters, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""

TOPK_SQL = f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {USABLE}),
p AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM x q JOIN x c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 5"""

LM_SQL = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce({CRC32.format(x="doc_id::VARCHAR")} % 7 = 2, false) AS held_out,
 list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS t FROM documents),
k AS (SELECT row_id, held_out, unnest(list_prepend('', t[:-2])) AS u, unnest(t) AS w FROM d),
c1 AS (SELECT w, COUNT(*) AS c FROM k WHERE NOT held_out GROUP BY 1), c2 AS (SELECT u, w, COUNT(*) AS c FROM k WHERE NOT held_out GROUP BY 1, 2),
n AS (SELECT SUM(c)::BIGINT AS n, COUNT(*) AS v FROM c1),
s AS (SELECT row_id, COUNT(*) AS n_tokens, COUNT(a.c) AS n_known, SUM(log10((coalesce(a.c, 0) + 1) / (n + v + 1.0))) AS base,
 SUM(log10((coalesce(p.c, 0) + 50 * CASE WHEN a.c IS NULL THEN 0.5 * v ELSE a.c - 0.5 END / n) / (coalesce(b.c, 0) + 50))) AS score
 FROM k CROSS JOIN n LEFT JOIN c1 a ON a.w = k.w LEFT JOIN c1 b ON b.w = k.u LEFT JOIN c2 p ON p.u = k.u AND p.w = k.w GROUP BY 1)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score FROM s JOIN d USING (row_id), n"""

DEDUP_SQL = f"""WITH RECURSIVE x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) >= 0.93),
w AS (SELECT a AS node, a AS seen FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a), c AS (SELECT node, MIN(seen) AS component_id FROM w GROUP BY 1), n AS (SELECT a, COUNT(*) AS n_links FROM e GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id"""

_VERDICT = "CASE WHEN {f2} THEN 'allow' WHEN {f1} THEN 'block' WHEN {f3} THEN 'block' WHEN {f4} THEN 'block' WHEN {f0} THEN 'allow' END"
_FITS = {f"f{i}": f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for i, r in enumerate(RULES)}
_HTTP = r"regexp_extract(regexp_replace({u}, '#.*$', ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {k})"
_ATTR = " || ".join(rf"""regexp_extract(tag, '(?is)\s{{name}}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', {k})""" for k in (1, 2, 3))
URL_SQL = rf"""WITH RECURSIVE tags AS (SELECT url AS a, unnest(list_concat(regexp_extract_all(html, '(?is)<link\s[^>]*>'), regexp_extract_all(html, '(?is)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh["'']?[^>]*>'))) AS tag FROM pages WHERE url IS NOT NULL AND regexp_matches(lower(html), 'canonical|refresh')),
tos AS (SELECT a, regexp_replace(CASE WHEN starts_with(lower(tag), '<link') THEN CASE WHEN list_contains(regexp_split_to_array(lower(trim({_ATTR.format(name='rel')})), '\s+'), 'canonical') THEN trim({_ATTR.format(name='href')}) END ELSE regexp_extract(tag, '(?is)url\s*=\s*["'']?([^\s"''>]+)', 1) END, '(?i)&(amp|#38|#x26);', '&', 'g') AS b FROM tags),
one AS (SELECT regexp_replace(a, '#.*$', '') AS a, regexp_replace(CASE WHEN starts_with(b, '//') THEN regexp_extract(a, '^([^:/]+:)//', 1) || b WHEN starts_with(b, '/') THEN regexp_extract(a, '^([^:/]+://[^/?#]*)', 1) || b WHEN contains(b, '://') THEN b END, '#.*$', '') AS b FROM tos),
e AS (SELECT a, b FROM one WHERE b IS NOT NULL UNION SELECT b, a FROM one WHERE b IS NOT NULL),
w AS (SELECT a AS node, a AS seen FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a),
j AS (SELECT node, translate({_HTTP.format(u='seen', k=1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {_HTTP.format(u='seen', k=2)} AS path FROM w),
carried AS (SELECT node, bool_or(({_VERDICT.format(**_FITS)}) = 'allow') AS allowed, bool_or(({_VERDICT.format(**_FITS)}) = 'block') AS blocked FROM j GROUP BY 1),
p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS node, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path, CASE WHEN {_FITS['f2']} THEN '{RULES[2].text}' WHEN {_FITS['f1']} THEN '{RULES[1].text}' WHEN {_FITS['f3']} THEN '{RULES[3].text}' WHEN {_FITS['f4']} THEN '{RULES[4].text}' WHEN {_FITS['f0']} THEN '{RULES[0].text}' END AS rule,
 coalesce({_VERDICT.format(**_FITS)}, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict FROM p LEFT JOIN carried USING (node)"""

_DRAW = "('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), {i}, 8))::BIGINT"
FIM_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
 {_DRAW.format(i=1)} AS h1, {_DRAW.format(i=9)} AS h2, {_DRAW.format(i=17)} AS h3, {_DRAW.format(i=25)} AS h4 FROM documents),
f AS (SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
 CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
g AS (SELECT *, array_to_string(t[:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM g"""

TRIE_SQL = f"""WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS l, {CRC32.format(x="conv_id::VARCHAR")} % 9 AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.l[:o.h], []), o.l[o.h + 1:]) AS l FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5),
m AS (SELECT conv_id, d, l[:d] AS k, d = len(l) AS ends FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT d, k, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY d, k),
c AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT COUNT(*) FROM n x WHERE x.d = n.d + 1 AND x.k[:n.d] = n.k) AS n_children FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.k = n.k[:n.d - 1])
SELECT a.conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children, COUNT(*) FILTER (WHERE u.n_children = 0) AS n_leaves, SUM((u.n_convs - 1) * coalesce(strlen(u.k[u.d].t), 0))::BIGINT AS saved_tokens, a.ends_sha256
FROM c a JOIN c u ON u.d >= a.d AND u.k[:a.d] = a.k GROUP BY a.conv_id, a.d, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256"""

#: Trained scores, random draws, merges, XXH64 and grammars are beyond SQL: the other queries are tested against plain versions.
ORACLE_SQL: dict[str, str] = {"op2_topk": TOPK_SQL, "op6_lm": LM_SQL, "op8_embed_dedup": DEDUP_SQL, "op9_url_filter": URL_SQL, "op11_fim": FIM_SQL, "op13_prefix_trie": TRIE_SQL}
