"""Registered queries of this folder, and the SQL that some of them can be checked against."""

import public_tokenizers

from wardflow.llm import (
    bpe, decontaminate, embedding_dedup, html_text, language, licence, ngram_join, prefix_trie, quality, ranked_search, token_count,
    token_file, warc)

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_embedding_near_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.root),
c AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)""")
def op1_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""")
def op2_warc(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query("op3_quality")
def op3_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_language")
def op4_language(spark, sf_dir):
    return language.language_report(table(spark, sf_dir, "documents"))


@query("op5_ngram_jaccard_join", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.root)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)""")
def op5_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


@query("op6_licence_scan")
def op6_licence_scan(spark, sf_dir):
    return licence.licence_report(table(spark, sf_dir, "documents"))


@query("op7_decontamination")
def op7_decontamination(spark, sf_dir):
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_token_file")
def op8_token_file(spark, sf_dir):
    manifest = token_file.write(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return token_file.read(manifest, with_ids=False)


@query("op9_bpe")
def op9_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query("op10_token_count")
def op10_token_count(spark, sf_dir):
    return token_count.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query("op11_prefix_trie", r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(
    length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS i,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(turn ORDER BY i) AS turns, list_reduce(list_prepend(4294967295, list_transform(
    string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b:
    list_reduce(list_prepend(xor(s, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS s FROM t GROUP BY c),
h AS (SELECT *, xor(s, 4294967295) % 6 AS h FROM own),
whole AS (SELECT a.c, coalesce(b.turns, [])[1:a.h] || a.turns[a.h + 1:] AS turns FROM h a LEFT JOIN own b ON b.c = a.c - a.c % 100),
member AS (SELECT c, d, turns[1:d] AS key, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM whole)),
node AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM member GROUP BY key, d),
child AS (SELECT key[1:d - 1] AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
part AS (SELECT key[1:a] AS key, n, saved FROM (SELECT node.key, coalesce(child.n, 0) AS n,
  CASE WHEN d > 0 THEN (n_convs - 1) * length(node.key[d].text) ELSE 0 END AS saved, unnest(range(d + 1)) AS a FROM node LEFT JOIN child USING (key))),
total AS (SELECT key, count(*) FILTER (n = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM part GROUP BY key)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(child.n, 0) AS n_children, total.n_leaves, total.saved_tokens, n.ends_sha256
FROM node n JOIN total ON total.key = n.key LEFT JOIN child ON child.key = n.key LEFT JOIN node p ON n.d > 0 AND p.d = n.d - 1 AND p.key = n.key[1:n.d - 1]""")
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_ranked_search", r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
docs AS (SELECT *, len(t) AS n FROM d WHERE len(t) > 0),
size AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
cell AS (SELECT i, doc_id, n, term, count(*) AS tf FROM (SELECT i, doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM cell, size GROUP BY term),
part AS (SELECT i, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))) AS impact FROM cell JOIN w USING (term), size),
s AS (SELECT item_id, i, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM item JOIN part USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def op12_ranked_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_html_text")
def op13_html_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))
