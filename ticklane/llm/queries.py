"""Queries of the numbered operators: each over its whole table, with production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.llm import (
    bpe, byte_gru, contamination, html_text, lexical_search, line_crf, near_join, pii, prefix_trie, rules, suffix_dedup,
    token_counts, toxicity,
)

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learned from rows outside the held-out fifth only."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = rules.score(docs, rules.train(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    return contamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, pii.BASE)
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages are learned from rows outside the held-out quarter only; a row without an id is not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return byte_gru.predict(docs, byte_gru.train(docs.filter(~held_out))).withColumn("held_out", held_out)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_crf, op2_suffix_dedup, op3_rule_ensemble, op4_html_text, op5_bpe_codec,
        op6_token_counts, op7_toxicity, op8_decontamination, op9_pii, op10_ngram_join, op11_prefix_trie, op12_lexical_search,
        op13_byte_gru,
    )
}

#: Words and shingles of texts. An item with fewer than five words is one shingle.
_SHINGLES = r"""
doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
)"""

ORACLE_SQL = {
    "op8_decontamination": rf"""
WITH {_SHINGLES},
item_words AS (
    SELECT item_id, w, least(len(w), 5) AS width FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x20\x09-\x0D]+') AS w
        FROM benchmark)
    WHERE len(w) > 0
),
item_shingles AS (
    SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS s
    FROM item_words, range(1, len(w) - width + 2) AS r(i)
),
sizes AS (SELECT item_id, width, count(*) AS n_item FROM item_shingles GROUP BY ALL),
doc_shingles AS (
    SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS s
    FROM doc_words, (SELECT DISTINCT width FROM item_words), range(1, len(w) - width + 2) AS r(i)
)
SELECT doc_id, item_id, n_item::INTEGER AS n_item, count(*)::INTEGER AS n_shared
FROM item_shingles JOIN doc_shingles USING (width, s) JOIN sizes USING (item_id, width)
GROUP BY ALL HAVING 100 * count(*) >= 75 * n_item
""",
    "op10_ngram_join": rf"""
WITH RECURSIVE {_SHINGLES},
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM doc_words, range(1, greatest(len(w) - 4, least(len(w), 1)) + 1) AS r(i)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes AS x ON x.doc_id = a.doc_id JOIN sizes AS y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),
reached AS (
    SELECT doc_id AS node, doc_id AS root FROM documents
    UNION
    SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.node
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.root) AS component_id
FROM documents AS d LEFT JOIN sizes AS s ON s.doc_id = d.doc_id JOIN reached AS r ON r.node = d.doc_id
GROUP BY d.doc_id, s.n
""",
    "op11_prefix_trie": rf"""
WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
    SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
           flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_transform(range(8), lambda b: (ascii(x)::BIGINT >> b) & 1))) AS bits
    FROM own GROUP BY conv_id
),
convs AS (
    SELECT conv_id, n, base, xor(list_reduce(bits, lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295::BIGINT), 4294967295) % 4 AS h
    FROM ids
),
turns AS (
    SELECT c.conv_id, o.i + 1 AS d, o.role, o.text FROM convs AS c JOIN own AS o ON o.conv_id = c.base AND o.i < c.h
    UNION ALL
    SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + o.i - c.h + 1, o.role, o.text
    FROM convs AS c JOIN own AS o ON o.conv_id = c.conv_id AND o.i >= c.h LEFT JOIN convs AS b ON b.conv_id = c.base
),
members AS (
    SELECT conv_id, d, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS p,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
    FROM turns
    UNION ALL
    SELECT conv_id, 0, '', 0 FROM convs
),
lengths AS (SELECT conv_id, max(d) AS d FROM members GROUP BY conv_id),
ends AS (
    SELECT d, p, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM members JOIN lengths USING (conv_id, d) GROUP BY d, p
),
nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM members GROUP BY d, p),
children AS (
    SELECT up.d, up.p, count(*) AS n FROM nodes AS k JOIN members AS up ON up.conv_id = k.conv_id AND up.d = k.d - 1 GROUP BY up.d, up.p
),
subtrees AS (
    SELECT up.d, up.p, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((k.n_convs - 1) * k.words) AS saved
    FROM nodes AS k JOIN members AS up ON up.conv_id = k.conv_id AND up.d <= k.d LEFT JOIN children AS c ON c.d = k.d AND c.p = k.p
    GROUP BY up.d, up.p
),
parents AS (SELECT n.d, n.p, o.conv_id FROM nodes AS n JOIN members AS m ON m.conv_id = n.conv_id AND m.d = n.d - 1 JOIN nodes AS o ON o.d = m.d AND o.p = m.p)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes AS n JOIN subtrees AS s USING (d, p) LEFT JOIN children AS c USING (d, p) LEFT JOIN ends AS e USING (d, p) LEFT JOIN parents AS u USING (d, p)
""",
    "op12_lexical_search": r"""
WITH found AS (
    SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE doc_id IS NOT NULL
),
docs AS (SELECT doc_id, doc, terms, len(terms) AS n FROM found WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
items AS (SELECT item_id, min(coalesce(text, '')) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
item_terms AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM items
),
tfs AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM tfs, totals WHERE term IN (SELECT term FROM item_terms) GROUP BY term, n_docs
),
scores AS (
    SELECT item_id, doc_id, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM item_terms JOIN weights USING (term) JOIN tfs USING (term) JOIN docs USING (doc), totals
    GROUP BY item_id, doc_id, doc
),
places AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM places WHERE rank <= 50
""",
}
