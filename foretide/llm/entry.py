"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.llm import chat, decontaminate, language, licenses, merkle, neardup, negatives, packing, pii, repeats, topk, toxicity, urls
from foretide.llm.common import table

#: The rules that op10 applies.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(chat.neighbours(table(spark, sf_dir, "conversations")))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii, "op2_licenses": op2_licenses, "op3_repeats": op3_repeats, "op4_topk": op4_topk, "op5_decontaminate": op5_decontaminate, "op6_packing": op6_packing, "op7_toxicity": op7_toxicity, "op8_neardup": op8_neardup, "op9_preference": op9_preference, "op10_urls": op10_urls, "op11_language": op11_language, "op12_negatives": op12_negatives, "op13_manifest": op13_manifest}


def _op2_sql() -> str:
    def form(text: str) -> str:
        t = f"translate(coalesce({text}, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
        t = f"regexp_replace({t}, '{licenses.COPYRIGHT_LINE}', '', 'g')"
        t = f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"
        for one, other in licenses.SPELLINGS:
            t = f"replace({t}, '{other}', '{one}')"
        return t

    listed = ", ".join(f"('{k}', '{v}')" for k, v in licenses.KNOWN_DIGESTS.items())
    known = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.KNOWN.items())
    return f"""
    WITH known(license, t) AS (VALUES {known}),
    listed(license, d) AS (VALUES {listed}),
    each AS (SELECT sha256({form("t")}) AS d, license FROM known UNION ALL SELECT d, license FROM listed),
    digests AS (SELECT d AS canonical_sha256, min(license) AS license FROM each GROUP BY 1)
    SELECT d.doc_id, d.canonical_sha256, k.license
    FROM (SELECT doc_id, sha256({form("text")}) AS canonical_sha256 FROM documents) d LEFT JOIN digests k USING (canonical_sha256)
    """


OP9_SQL = r"""
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS chosen, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
both_sides AS (
  SELECT c.pair_id, c.pos, c.role = r.role AND c.text = r.text AS same
  FROM n c JOIN n r ON c.pair_id = r.pair_id AND c.pos = r.pos AND c.chosen AND NOT r.chosen),
shorter AS (SELECT pair_id, least(count(*) FILTER (chosen), count(*) FILTER (NOT chosen)) AS m FROM n GROUP BY 1),
common AS (
  SELECT s.pair_id, coalesce(min(b.pos) FILTER (NOT b.same) - 1, s.m) AS n_common
  FROM shorter s LEFT JOIN both_sides b ON b.pair_id = s.pair_id GROUP BY s.pair_id, s.m),
r AS (
  SELECT n.*, c.n_common, '<|' || role || chr(124) || '>' || chr(10) || text || chr(10) AS part FROM n JOIN common c USING (pair_id)),
placed AS (
  SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY pair_id, chosen ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS whole
  FROM r WHERE pos > n_common)
, done AS (
  SELECT pair_id, chosen, string_agg(part, '' ORDER BY pos) AS body,
    coalesce(string_agg(CAST(whole AS BIGINT) || ':' || CAST(whole + length(text) AS BIGINT), ',' ORDER BY pos) FILTER (role = 'assistant'), '') AS mask
  FROM placed GROUP BY 1, 2)
SELECT c.pair_id, CAST(c.n_common AS BIGINT) AS n_common,
  coalesce((SELECT string_agg(part, '' ORDER BY pos) FROM r WHERE r.pair_id = c.pair_id AND r.chosen AND r.pos <= c.n_common), '') AS prompt,
  CASE WHEN a.has THEN coalesce(x.body, '') END AS chosen, CASE WHEN b.has THEN coalesce(y.body, '') END AS rejected,
  CASE WHEN a.has THEN coalesce(x.mask, '') END AS chosen_mask, CASE WHEN b.has THEN coalesce(y.mask, '') END AS rejected_mask
FROM common c
LEFT JOIN (SELECT DISTINCT pair_id, true AS has FROM n WHERE chosen) a USING (pair_id)
LEFT JOIN (SELECT DISTINCT pair_id, true AS has FROM n WHERE NOT chosen) b USING (pair_id)
LEFT JOIN (SELECT * FROM done WHERE chosen) x USING (pair_id)
LEFT JOIN (SELECT * FROM done WHERE NOT chosen) y USING (pair_id)
"""

OP10_SQL = """
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '\\A([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '\\A[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host, path,
  (SELECT rhost || rpath FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost) + length(rpath) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost) + length(rpath) DESC LIMIT 1), 'allow') AS verdict
FROM q
""".format(rules=", ".join(str(r) for r in URL_RULES), upper=urls.UPPER, lower=urls.LOWER)

OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


# CRC-32 byte by byte and bit by bit; a tree is a list of digests a level; a proof is a list of "before|after"
_BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END"
_CRC = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) for i in range(8)]), lambda x, y: {_BIT}))"
_UP = "list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))"
_RUN = "3 * (place // 3)"
OP13_SQL = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) AS leaf,
    sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {_field("replace(text, chr(10), '')")}) AS spoilt,
    doc_id IS NOT NULL AND xor({_CRC}, CAST(4294967295 AS BIGINT)) % 2 = 0 AS chosen
  FROM documents),
d AS (SELECT *, CASE WHEN chosen THEN spoilt ELSE leaf END AS now, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM f),
lv(tree, level, nodes) AS (SELECT tree, 0, list(leaf ORDER BY i) FROM d GROUP BY tree UNION ALL SELECT tree, level + 1, {_UP} FROM lv WHERE len(nodes) > 1),
sub AS (SELECT tree, nodes[1] AS subroot FROM lv WHERE len(nodes) = 1),
tv(level, nodes) AS (SELECT 0, list(subroot ORDER BY tree) FROM sub UNION ALL SELECT level + 1, {_UP} FROM tv WHERE len(nodes) > 1),
steps AS (
  SELECT d.tree, d.i, lv.level AS k, lv.nodes, i // CAST(pow(3, lv.level) AS BIGINT) AS place FROM d JOIN lv ON lv.tree = d.tree WHERE len(lv.nodes) > 1
  UNION ALL SELECT d.tree, d.i, 1000 + tv.level, tv.nodes, d.tree // CAST(pow(3, tv.level) AS BIGINT) AS place FROM d, tv WHERE len(tv.nodes) > 1),
sides AS (SELECT tree, i, k, array_to_string(nodes[{_RUN} + 1 : place], '') AS before, array_to_string(nodes[place + 2 : {_RUN} + 3], '') AS after FROM steps),
proofs AS (SELECT tree, i, string_agg(before || after, '' ORDER BY k) AS proof, list(before || '|' || after ORDER BY k) AS pieces FROM sides GROUP BY 1, 2),
folded AS (
  SELECT d.doc_id, d.leaf, sub.subroot, (SELECT nodes[1] FROM tv WHERE len(nodes) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(now, coalesce(pieces, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM d JOIN sub ON sub.tree = d.tree LEFT JOIN proofs p ON p.tree = d.tree AND p.i = d.i)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

SQL = {"op12_negatives": OP12_SQL, "op13_manifest": OP13_SQL, "op4_topk": OP4_SQL, "op2_licenses": _op2_sql(), "op9_preference": OP9_SQL, "op10_urls": OP10_SQL}
