"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roundweave.llm import bpe, html, manifest, mixing, near_dedup, permutations, pii, quality, search, substrings, token_counts, toxicity, whitening
from roundweave.llm.common import table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def rank_file(name: str = TOKENIZER) -> tuple[bytes, str]:
    """Content of a public rank file, read on the driver, and its pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and of decoded bytes, per document."""
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), *rank_file(), digests=True)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, kept as a table of segment trees, and after three edits that are applied to that table."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, *rank_file(), edits=token_counts.sample_edits).drop("text", "leaf_chars", "leaf_tokens")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), spans=False)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of the base rule alone, for which there is SQL."""
    return op3_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set, component and whether it stays, of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans alone, for which there is SQL."""
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return search.top_k(vectors, vectors["vec_id"] % 50 == 0, k=5)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings that repeat anywhere."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that may be learned from."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size"))
    return mixing.mix_counts(sized).select("doc_id", "size", "source_size", "target", "taken")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def whitening_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of the whitening, for which there is SQL."""
    return op11_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every hundredth vector, as far as the permutation index finds them."""
    vectors = table(spark, sf_dir, "embeddings")
    return permutations.nearest(vectors, vectors["vec_id"] % 100 == 0, k=10)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it still proves once some are tampered with."""
    return manifest.manifest(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source
), w AS (
  SELECT *, CASE no % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size::DOUBLE * 2 AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM s
), l AS (
  SELECT *, cap / weight AS fill,
         (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT *, CASE WHEN best < fill THEN best * weight ELSE cap END AS target
  FROM (SELECT *, max(CASE WHEN level <= fill THEN level END) OVER () AS best FROM l)
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.no, t.budget,
         sum(d.size) OVER (PARTITION BY t.no ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.no, e, copy, size, budget, sum(size) OVER (ORDER BY (source_size * copy + e) / target, q.no, copy, e ROWS UNBOUNDED PRECEDING) AS run
  FROM q, (SELECT unnest([0, 1]) AS copy) WHERE size > 0 AND target > 0
), n AS (SELECT no, e, count(*) AS copies FROM c WHERE run <= floor(budget) GROUP BY ALL)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN coalesce(copies, 0) ELSE 0 END * size)::BIGINT AS taken
FROM q LEFT JOIN n USING (no, e)
"""


QUALITY_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), o AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g
), r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM o WHERE n > 1) GROUP BY doc_id
), l AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def _spans_sql(kind: str, no: int, pattern: str, passes: str) -> str:
    """Spans of one kind in SQL: what lies between the matches and these themselves say where a match begins."""
    found = f"list_zip(regexp_split_to_array(t, '{pattern}'), regexp_extract_all(t, '{pattern}'))"
    before = "list_sum(list_transform(z[1:i], lambda y: len(y[1]))) + coalesce(list_sum(list_transform(z[1:i - 1], lambda y: len(y[2]))), 0)"
    ok = f"list_filter(range(1, len(z)), lambda i: {passes.format(x='z[i][2]')})"
    return f"SELECT doc_id, {no} AS no, list_transform({ok}, lambda i: {{'a': ({before})::BIGINT, 'no': {no}, 's': '{kind}:' || ({before})::BIGINT || ':' || (({before}) + len(z[i][2]))::BIGINT}}) AS s FROM (SELECT doc_id, {found} AS z FROM d)"


DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, len({DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN reverse({DIGITS})[k]::INT WHEN reverse({DIGITS})[k]::INT > 4 THEN 2 * reverse({DIGITS})[k]::INT - 9 ELSE 2 * reverse({DIGITS})[k]::INT END)) % 10 = 0"
PII_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split({x}, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 0) > 255)) = 0"),
    ("card", "[0-9](?:[ -]?[0-9])+", f"len({DIGITS}) BETWEEN 14 AND 19 AND {LUHN}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"len({DIGITS}) BETWEEN 10 AND 15"),
]
PII_BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), k AS ({' UNION ALL '.join(_spans_sql(kind, no, pattern, passes) for no, (kind, pattern, passes) in enumerate(PII_KINDS))}
), c AS (SELECT doc_id, flatten(list(s ORDER BY no)) AS s FROM k GROUP BY doc_id)
SELECT doc_id, {', '.join(f"len(list_filter(s, lambda x: x.no = {no}))::BIGINT AS n_{kind}" for no, (kind, _, _) in enumerate(PII_KINDS))},
  sha256(coalesce(array_to_string(list_transform(list_sort(s), lambda x: x.s), ','), '')) AS base_sha256 FROM c
"""


#: Marks that repeat are found by their windows of three; runs of equal windows at one distance make longer repeats.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]') AS m FROM documents
), g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), o AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g
), r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM o WHERE n > 1) GROUP BY doc_id
), l AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id
), tri AS (SELECT doc_id, i, array_to_string(m[i:i + 2], ' ') AS g FROM (SELECT doc_id, m, unnest(range(1, len(m) - 1)) AS i FROM d)
), again AS (SELECT doc_id, i, g FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1
), cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM again
), fr AS (SELECT cov.doc_id, sum(len(m[i])) AS n FROM cov JOIN d USING (doc_id) GROUP BY cov.doc_id
), met AS (SELECT a.doc_id, a.i, b.i - a.i AS gap FROM again a JOIN again b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i
), run AS (SELECT doc_id, count(*) + 2 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, gap ORDER BY i) AS island FROM met) GROUP BY doc_id, gap, island
), lr AS (SELECT doc_id, max(n) AS n FROM run GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed,
    coalesce(fr.n::DOUBLE / list_sum(list_transform(m, lambda x: len(x))), 0) AS repeat_fraction,
    coalesce(lr.n, CASE WHEN len(list_distinct(list_transform(range(1, len(m)), lambda i: m[i] || ' ' || m[i + 1]))) < len(m) - 1 THEN 2 WHEN len(list_distinct(m)) < len(m) THEN 1 ELSE 0 END)::BIGINT AS longest_repeat
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN fr USING (doc_id) LEFT JOIN lr USING (doc_id)
)
SELECT *, NOT base_failed AND repeat_fraction <= 0.3 AND longest_repeat <= 50 AS kept FROM f
"""


#: All windows of 400 bytes, told apart by their digests.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, row_number() OVER () AS r FROM documents
), w AS (SELECT r, i, md5(b[i:i + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)
), g AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), s AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM g
), n AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS no FROM s
), x AS (SELECT r, no, min(i) AS a, max(i) + 399 AS z FROM n GROUP BY r, no
), p AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM x GROUP BY r
), q AS (SELECT doc_id, b, a, coalesce(len(a), 0) AS k, z FROM d LEFT JOIN p USING (r))
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(list_sum(list_transform(range(1, k + 1), lambda j: z[j] - a[j] + 1)), 0)::BIGINT AS n_removed, k::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, k + 1), lambda j: hex(b[CASE WHEN j = 0 THEN 1 ELSE z[j] + 1 END:CASE WHEN j = k THEN octet_length(b) ELSE a[j + 1] - 1 END])), ''))) AS kept_sha256 FROM q
"""


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON d.doc_id = c.a
"""


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s
) WHERE rank <= 5
"""


WHITENING_DEVIATION_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::HUGEINT + 100000) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), e AS (SELECT r, vec_id, unnest(range(len(x))) AS i, unnest(x) AS x FROM v
), s AS (SELECT i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM e GROUP BY i)
SELECT any_value(vec_id) AS vec_id, any_value(n)::BIGINT AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM e JOIN s USING (i) GROUP BY r
"""


def _leaf_sql(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}::VARCHAR)) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


#: The crc32 is folded bit by bit, without the last complement, so an odd one here is even there. Trees grow level by level; ``f`` and ``z`` go up with a tampered leaf.
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf_sql("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    {_leaf_sql("doc_id", "source", "lang", "n_chars", "CASE WHEN c % 2 = 1 THEN replace(text, chr(10), '') ELSE text END")} AS tampered
  FROM (SELECT *, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda crc, x: list_reduce(range(8), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(crc, x)), 4294967295) AS c FROM documents)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d
), t(source, level, i, h, n) AS (
  SELECT source, 0, i, leaf, n FROM o
  UNION ALL SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY source, level, i // 3
), runs AS (SELECT source, level, i // 3 AS j, list(h ORDER BY i) AS run FROM t GROUP BY source, level, i // 3
), so AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u(level, i, h, n) AS (
  SELECT 0, i, subroot, n FROM so
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY level, i // 3
), tops AS (SELECT level, i // 3 AS j, list(h ORDER BY i) AS run FROM u GROUP BY level, i // 3
), f(r, source, level, i, h, proof, n) AS (
  SELECT r, source, 0, i, tampered, '', n FROM o
  UNION ALL SELECT f.r, f.source, f.level + 1, f.i // 3, sha256(array_to_string(run[1:f.i % 3] || [f.h] || run[f.i % 3 + 2:], '')), f.proof || array_to_string(run[1:f.i % 3] || run[f.i % 3 + 2:], ''), (n + 2) // 3
  FROM f JOIN runs ON f.source IS NOT DISTINCT FROM runs.source AND f.level = runs.level AND f.i // 3 = runs.j WHERE n > 1
), z(r, level, i, h, proof, n) AS (
  SELECT r, 0, so.i, h, proof, so.n FROM f JOIN so ON f.source IS NOT DISTINCT FROM so.source WHERE f.n = 1
  UNION ALL SELECT z.r, z.level + 1, z.i // 3, sha256(array_to_string(run[1:z.i % 3] || [z.h] || run[z.i % 3 + 2:], '')), z.proof || array_to_string(run[1:z.i % 3] || run[z.i % 3 + 2:], ''), (n + 2) // 3
  FROM z JOIN tops ON z.level = tops.level AND z.i // 3 = tops.j WHERE n > 1
)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, z.h AS folded_root, z.h = u.h AS verified
FROM d JOIN so ON d.source IS NOT DISTINCT FROM so.source JOIN z ON z.r = d.r AND z.n = 1 JOIN u ON u.n = 1
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "quality_base": quality_base,
    "op4_near_dedup": op4_near_dedup,
    "op5_pii": op5_pii,
    "pii_base": pii_base,
    "op6_html": op6_html,
    "op7_search": op7_search,
    "op8_bpe": op8_bpe,
    "op9_substrings": op9_substrings,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "whitening_deviation": whitening_deviation,
    "op12_neighbours": op12_neighbours,
    "op13_manifest": op13_manifest,
}

ORACLES: dict[str, str] = {
    "op3_quality": OP3_SQL,
    "op9_substrings": OP9_SQL,
    "op4_near_dedup": OP4_SQL,
    "quality_base": QUALITY_BASE_SQL,
    "pii_base": PII_BASE_SQL,
    "op7_search": OP7_SQL,
    "op10_mixing": OP10_SQL,
    "whitening_deviation": WHITENING_DEVIATION_SQL,
    "op13_manifest": OP13_SQL,
}
