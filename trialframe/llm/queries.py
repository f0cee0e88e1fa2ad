"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embedding_dedup, langid, licenses, mixing, packing, pii, prefix_trie, sharding, simhash, token_files, warc, whitening
from .shared import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to dictionary-compressed WARC archives and read back."""
    path = fresh_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, with_payload=False).drop("payload", "url")


def op2_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector, by anisotropic four-bit codes and exact reranking."""
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents by a Feistel permutation; law `rows`: counts one apart at most."""
    shards = sharding.document_shards(_table(spark, sf_dir, "documents"), 24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens along a Hilbert curve."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.with_crc32(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with target weights takes of each document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to Re-Pair shard files and read back."""
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, score and rejection of all documents."""
    return langid.predictions(_table(spark, sf_dir, "documents"))


def op5_int8_tile_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings at cosine 0.9."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate class of all documents."""
    classes = simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: rule spans, and those that boosted trees add."""
    return pii.found(_table(spark, sf_dir, "documents"))


def op11_bitsliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along the leading components of their exact covariance, whitened."""
    return whitening.by_component(whitening.whiten(_table(spark, sf_dir, "embeddings")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each begun like the first of its twenty."""
    turns, convs = prefix_trie.spliced(prefix_trie.turns(_table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, convs).drop("name", "parent")


def op13_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return licenses.digest(licenses.license_spans(_table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_dictionary, op2_anisotropic_search, op3_feistel_shards, op4_language_id, op5_int8_tile_dedup,
        op6_hilbert_packing, op7_systematic_mix, op8_repair_token_files, op9_gray_simhash, op10_boosted_pii,
        op11_bitsliced_whitening, op12_conversation_trie, op13_template_licenses,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op7_systematic_mix": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
        c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
        f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
            FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
        l AS (SELECT max((total - full_) / open_) FILTER ((total - full_) / open_ <= cap / w) AS level FROM f),
        t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM f, l),
        r AS (SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS k,
            CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
            CAST(concat('0x', substr(md5(concat('42:', CASE WHEN d.source IS NULL THEN 'null' ELSE concat('s', d.source) END)), 1, 7)) AS BIGINT) / 268435456.0::DOUBLE AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST((floor(rate * (k + 1) + u) - floor(rate * k + u)) * size AS BIGINT) AS taken FROM r""",
    "op12_conversation_trie": r"""
        WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        h AS (SELECT DISTINCT c, c - c % 20 AS b, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
            lambda a, x: list_reduce([xor(a, x)] || range(8), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 4 AS h FROM o),
        r AS (SELECT h.c, o.pos, o.role, o.text FROM h JOIN o ON o.c = h.b AND o.pos <= h.h
            UNION ALL SELECT h.c, 10 + o.pos, o.role, o.text FROM h JOIN o ON o.c = h.c AND o.pos > h.h),
        p AS (SELECT c, row_number() OVER w AS depth, list(sha256(concat(length(role), ':', role, text))) OVER w AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
            FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)),
        m AS (SELECT c, depth, sha256(CAST(path AS VARCHAR)) AS node, words FROM p UNION ALL SELECT c, 0, 'root', 0 FROM h),
        e AS (SELECT c, max(depth) AS depth FROM m GROUP BY c),
        n AS (SELECT m.node, m.depth, min(m.c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (e.depth = m.depth), '') AS ids
            FROM m JOIN e USING (c) GROUP BY ALL),
        k AS (SELECT DISTINCT a.node, b.node AS child FROM m a JOIN m b ON a.c = b.c AND b.depth = a.depth + 1),
        kids AS (SELECT node, count(*) AS n_children FROM k GROUP BY node),
        s AS (SELECT DISTINCT a.node, b.node AS below FROM m a JOIN m b ON a.c = b.c AND b.depth >= a.depth),
        t AS (SELECT s.node, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved_tokens, count(*) FILTER (kids.node IS NULL) AS n_leaves
            FROM s JOIN n ON n.node = s.below LEFT JOIN kids ON kids.node = s.below GROUP BY s.node)
        SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, sha256(n.ids) AS ends_sha256
        FROM n JOIN t USING (node) LEFT JOIN kids USING (node) LEFT JOIN k ON k.child = n.node LEFT JOIN n up ON up.node = k.node""",
    "op13_template_licenses": licenses.oracle_sql(),
}
