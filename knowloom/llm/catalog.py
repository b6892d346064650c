"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from knowloom.llm import byte_bpe, decontaminate, host_reputation, html_blocks, license_scan, pivot_join, prefix_trie, quality_cnn, ranked_search, simhash_ball, source_mix, unit_dedup, wavelet_shards
from knowloom.llm.shared import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_pivot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links and its component."""
    return pivot_join.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op1_pivot_join"] = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM e
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query
def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, by the longest rule that fits or else by its host's reputation."""
    return host_reputation.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


_FITS = "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '{1}') THEN '{2}'"
_BY_LENGTH = [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in sorted(URL_RULES, key=lambda r: -len(r[0]))]
_SHRINK = "(1 - r) / r AS s FROM (SELECT least(0.999, greatest(0.001, 1 / (count(*) FILTER (WHERE n > 0) + 1), coalesce((sum((k - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5))) AS r"

_POSTERIOR = "(k + s * m) / (n + s) AS m, ((k + s * m) / (n + s)) * (1 - (k + s * m) / (n + s)) / (n + s + 1) + (s / (n + s)) ** 2 * v AS v"

ORACLES["op2_host_reputation"] = f"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
ruled AS (
  SELECT *, CASE {" ".join("WHEN " + _FITS.format(h, p, r) for h, p, r, _ in _BY_LENGTH)} END AS rule,
         CASE {" ".join("WHEN " + _FITS.format(h, p, v) for h, p, _, v in _BY_LENGTH)} END AS fixed FROM cut),
named AS (
  SELECT host, count(fixed)::DOUBLE AS n, count(*) FILTER (WHERE fixed = 'block')::DOUBLE AS k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM ruled GROUP BY host),
hosts AS (
  SELECT host, n, k, CASE WHEN regexp_matches(name, '^[0-9.]+$|^\\[') THEN name ELSE array_to_string(list_slice(string_split(name, '.'), -1 - labels, -1), '.') END AS domain,
         CASE WHEN regexp_matches(name, '^[0-9.]+$|^\\[') THEN name ELSE array_to_string(list_slice(string_split(name, '.'), -labels, -1), '.') END AS suffix
  FROM (SELECT *, CASE WHEN len(string_split(name, '.')) > 2 AND array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') IN {host_reputation.SUFFIXES} THEN 2 ELSE 1 END AS labels FROM named)),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
whole AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m, coalesce(sum(n), 0) + 2 AS w FROM hosts),
suffixes AS (SELECT suffix, sum(domains.n) AS n, sum(k) AS k, any_value(m) AS m, any_value(m * (1 - m) / (w + 1)) AS v, sum(domains.n) > 0 AS known FROM domains, whole GROUP BY suffix),
s1 AS (SELECT {_SHRINK} FROM suffixes)),
by_suffix AS (SELECT suffix, known, {_POSTERIOR} FROM suffixes, s1),
d AS (SELECT suffix, domain, known, n, k, m, v FROM domains JOIN by_suffix USING (suffix)),
s2 AS (SELECT {_SHRINK} FROM d)),
by_domain AS (SELECT suffix, domain, known, {_POSTERIOR} FROM d, s2),
h AS (SELECT host, known, n, k, m, v FROM hosts JOIN by_domain USING (suffix, domain)),
s3 AS (SELECT {_SHRINK} FROM h)),
post AS (SELECT host, known, {_POSTERIOR} FROM h, s3)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN known AND m - {host_reputation.BOUND} * sqrt(v) > {host_reputation.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN post USING (host)
"""


@query
def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    tree = html_blocks.train(html_blocks.labelled(spark))
    return html_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), tree, html_too=False).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a license template that it holds."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


ORACLES["op4_license_scan"] = f"""
WITH t AS (SELECT unnest({sorted(license_scan.TEMPLATES)!r}) AS template, unnest([{", ".join("'" + license_scan.TEMPLATES[n].replace("'", "''") + "'" for n in sorted(license_scan.TEMPLATES))}]) AS text),
tw AS (SELECT template, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
tk AS (SELECT template, w, CASE WHEN len(w) >= 5 THEN 5 ELSE 3 END AS k FROM tw),
ts AS (SELECT DISTINCT template, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM tk)),
tn AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
ds AS (SELECT doc_id, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (VALUES (3), (5)) AS kinds(k))),
hits AS (SELECT doc_id, template, n, pos, ds.s FROM ds JOIN ts ON ds.k = ts.k AND ds.s = ts.s JOIN tn USING (template)),
w AS (SELECT doc_id, template, n, s, pos // n * n AS begin FROM hits UNION SELECT doc_id, template, n, s, greatest(pos // n - 1, 0) * n AS begin FROM hits),
shares AS (SELECT doc_id, template, begin, count(DISTINCT s) / any_value(n) AS share FROM w GROUP BY doc_id, template, begin)
SELECT doc_id, template, max(share) AS containment, min(begin) FILTER (WHERE share = best)::INT AS first_word
FROM (SELECT *, max(share) OVER (PARTITION BY doc_id, template) AS best FROM shares WHERE share >= 0.8) GROUP BY doc_id, template
"""


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the byte-level ranks and decoded again, as digests."""
    import public_tokenizers

    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(bpe.decode(bpe.encode(docs)))


@query
def op6_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its group of near-duplicates."""
    groups = simhash_ball.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the wavelet files of all token ids."""
    import public_tokenizers

    folder = f"{shared_folder(spark)}/llm-shards-{uuid.uuid4().hex}"
    wavelet_shards.write_texts(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end=1, vocabulary=49_408)
    return wavelet_shards.documents(wavelet_shards.shards(spark, folder))


@query
def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; learned from labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_cnn.score(docs.select("doc_id", "text"), quality_cnn.fit(docs, labels))
    return scored.select("doc_id", quality_cnn.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_cnn.THRESHOLD).cast("int").alias("predicted"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it leaks, with the alignment score."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that is left and the original offsets of what was removed, as ``start-end`` pairs."""
    found = unit_dedup.dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), " ")
    return found.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), F.size("removed").cast("long").alias("n_removed"), spans.alias("removed_spans"))


ORACLES["op10_unit_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k
  FROM (SELECT doc_id, string_split(regexp_replace(text, '(\n\s*)', '\1' || chr(31), 'g'), chr(31)) AS pieces FROM documents)),
placed AS (
  SELECT doc_id, k, piece, coalesce(sum(length(piece)) OVER before, 0)::BIGINT AS start, regexp_extract_all(lower(piece), '\S+') AS words,
         coalesce(sum(CASE WHEN regexp_matches(piece, '\n\s*\n') THEN 1 ELSE 0 END) OVER before, 0) AS paragraph
  FROM cut WINDOW before AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
units AS (
  SELECT doc_id, start, start + length(piece) AS stop, words FROM placed
  UNION ALL SELECT doc_id, min(start), max(start + length(piece)), flatten(list(words ORDER BY k)) FROM placed WHERE piece <> '' GROUP BY doc_id, paragraph HAVING count(*) > 1),
ranked AS (SELECT doc_id, start, stop, row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, start, stop) > 1 AS gone
           FROM units WHERE list_sum(list_transform(words, lambda w: CASE WHEN length(w) > 16 THEN length(w) // 2 ELSE 1 END)) >= 20),
gone AS (SELECT doc_id, start, stop FROM ranked AS r WHERE gone AND NOT EXISTS (
  SELECT 1 FROM ranked AS o WHERE o.gone AND o.doc_id = r.doc_id AND o.start <= r.start AND o.stop >= r.stop AND (o.start < r.start OR o.stop > r.stop))),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY k) AS text FROM placed AS p WHERE NOT EXISTS (SELECT 1 FROM gone AS g WHERE g.doc_id = p.doc_id AND p.start >= g.start AND p.start < g.stop) GROUP BY doc_id)
SELECT d.doc_id, coalesce(kept.text, '') AS text, length(coalesce(kept.text, ''))::BIGINT AS n_chars, count(g.start) AS n_removed,
       coalesce(string_agg(g.start || '-' || g.stop, ' ' ORDER BY g.start), '') AS removed_spans
FROM documents AS d LEFT JOIN kept USING (doc_id) LEFT JOIN gone AS g USING (doc_id) GROUP BY d.doc_id, kept.text
"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations, with its subtree's totals."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"

ORACLES["op11_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, turn, length(text) AS n_chars, md5(length(role) || ':' || role || text) AS digest FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k FROM d),
c AS (SELECT conv_id, count(*) AS own, {_CRC32} % 6 AS h, conv_id - conv_id % 100 AS base FROM d GROUP BY conv_id),
m AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS taken, least(c.h, coalesce(b.own, 0)) + greatest(c.own - c.h, 0) AS length FROM c LEFT JOIN c AS b ON c.base = b.conv_id),
s AS (
  SELECT conv_id, k - h + taken AS depth, length, digest, n_chars FROM k JOIN m USING (conv_id) WHERE k > h
  UNION ALL SELECT m.conv_id, k AS depth, length, digest, n_chars FROM k JOIN m ON k.conv_id = m.base WHERE k <= taken),
p AS (
  SELECT conv_id, depth, length, n_chars, list(digest) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM s
  UNION ALL SELECT conv_id, 0, length, 0, [] FROM m),
n AS (
  SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_chars) AS n_chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256 FROM p GROUP BY prefix),
kids AS (SELECT prefix[:-2] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (prefix)),
sums AS (
  SELECT p.prefix, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.n_chars)::BIGINT AS saved_tokens
  FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.prefix)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN sums USING (prefix) LEFT JOIN v AS u ON v.depth > 0 AND u.prefix = v.prefix[:-2]
"""


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item, from an index of all documents."""
    return ranked_search.search(ranked_search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 20)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op12_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
n AS (SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's budget and the words that the mix takes of it."""
    return source_mix.mix(table(spark, sf_dir, "documents"))


ORACLES["op13_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         greatest(0.05, coalesce(length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) / nullif(length(text), 0), 0)) AS quality,
         (('0x' || substr(md5(concat_ws(':', '13', doc_id)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
level AS (
  SELECT (any_value(budget) - sum(2.0 * a.source_size) FILTER (WHERE a.source_size / a.weight < b.source_size / b.weight)) / sum(a.weight) FILTER (WHERE a.source_size / a.weight >= b.source_size / b.weight) AS level,
         (any_value(budget)) / sum(a.weight) FILTER (WHERE a.source_size / a.weight >= b.source_size / b.weight) AS whole,
         count(*) FILTER (WHERE a.source_size / a.weight < b.source_size / b.weight) AS n_full, 2.0 * b.source_size / b.weight AS fills
  FROM s AS a, s AS b, (SELECT 1.5 * sum(source_size) AS budget FROM s) GROUP BY b.source, b.source_size, b.weight),
settled AS (SELECT min_by(CASE WHEN n_full = 0 THEN whole ELSE level END, fills) AS level FROM level WHERE CASE WHEN n_full = 0 THEN whole ELSE level END <= fills),
t AS (SELECT source, source_size, least(2.0 * source_size, coalesce(level * weight, 2.0 * source_size))::DOUBLE AS target FROM s, settled),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (
  SELECT doc_id, d.source, size, source_size, target, epochs, target - epochs * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / quality, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS reached
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, (size * (epochs + (reached < rest)::INT))::BIGINT AS taken FROM r
"""
