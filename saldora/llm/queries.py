"""Queries of this subpackage, one per operator, over the whole documents table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldora.llm.common import documents
from saldora.llm.dedup import exact_dedup
from saldora.llm.divergence import divergence
from saldora.llm.id_files import id_files
from saldora.llm.jaccard import jaccard_groups
from saldora.llm.langid import identify
from saldora.llm.mixing import mix
from saldora.llm.nbest import segmented
from saldora.llm.pseudo_likelihood import pseudo_likelihood
from saldora.llm.quality import assess
from saldora.llm.ranked_search import search
from saldora.llm.secrets import secret_spans
from saldora.llm.substring_dedup import substring_dedup
from saldora.llm.token_counts import token_counts

#: Folder of the public tokenizers' files on every machine; see tokenizer().
TOKENIZERS = None


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file: in the folder TOKENIZERS, else where the installed package has it."""
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mix_sources(spark, sf_dir):
    return mix(documents(spark, sf_dir)).drop("times")


def op2_quality_rules(spark, sf_dir):
    return assess(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_pseudo_likelihood(spark, sf_dir):
    return pseudo_likelihood(documents(spark, sf_dir))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_groups(documents(spark, sf_dir))


def op5_secret_spans(spark, sf_dir):
    return secret_spans(documents(spark, sf_dir))


def op6_language_id(spark, sf_dir):
    return identify(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op7_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op8_id_files(spark, sf_dir):
    return id_files(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op9_nbest_pieces(spark, sf_dir):
    return segmented(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op10_exact_dedup(spark, sf_dir):
    found = exact_dedup(documents(spark, sf_dir), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op11_substring_dedup(spark, sf_dir):
    return substring_dedup(documents(spark, sf_dir))


def op12_ranked_search(spark, sf_dir):
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_source_divergence(spark, sf_dir):
    return divergence(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_quality_rules, op3_pseudo_likelihood, op4_jaccard_join, op5_secret_spans, op6_language_id, op7_token_counts,
        op8_id_files, op9_nbest_pieces, op10_exact_dedup, op11_substring_dedup, op12_ranked_search, op13_source_divergence)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op11_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        s AS (SELECT doc_id, i, CASE WHEN i + 19 <= len(w) THEN md5(array_to_string(w[i:i + 19], ' ')) END AS k, word FROM u JOIN d USING (doc_id)),
        f AS (SELECT doc_id, i, word, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM s),
        c AS (SELECT doc_id, i, word, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
        r AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
    """,
    "op12_ranked_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        a AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
        u AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
        f AS (SELECT doc_id, t, any_value(u.n) AS n, count(*) AS tf FROM u GROUP BY doc_id, t),
        g AS (SELECT t, floor(1000 * ln((2 * a.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY t, a.n),
        q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM benchmark),
        s AS (SELECT item_id, doc_id, sum(g.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * f.n * a.n) // a.l))))::BIGINT AS score FROM q JOIN f USING (t) JOIN g USING (t), a GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10
    """,
    "op13_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        u AS (SELECT r, lang, source, unnest(w) AS t FROM d),
        k AS (SELECT lang, t, count(*) AS n FROM u GROUP BY lang, t HAVING count(DISTINCT r) >= 10),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT u.lang, source, t, count(*) AS n FROM u JOIN k USING (lang, t) GROUP BY ALL),
        m AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(m.total, 0) + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS q
            FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t LEFT JOIN m ON m.lang = g.lang AND m.source = g.source),
        x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
        y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        z AS (SELECT lang, source, 'term' AS part, t AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM z))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept,
               h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
    """,
}
