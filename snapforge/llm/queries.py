"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm import bpe, conversation_trie, decontamination, language, licenses, minhash, mixing, multi_index, simhash, toxicity, tree_weighting, whitening, windows
from snapforge.llm.common import LOWER, UPPER


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    """File of the tokenizer: SNAPFORGE_TOKENIZER, or the public one that is installed."""
    found = os.environ.get("SNAPFORGE_TOKENIZER")
    return found or os.path.join(os.path.dirname(find_spec("public_tokenizers").origin), "word_bpe_49k.json")


def op1_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.near_vectors(_table(spark, folder, "embeddings"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(_table(spark, folder, "documents"))


def op3_tree_weighting(spark: SparkSession, folder: str) -> DataFrame:
    return tree_weighting.score_texts(_table(spark, folder, "documents"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    found = language.train_and_identify(_table(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    cut = windows.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.edited_fingerprints(_table(spark, folder, "documents"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.train_and_score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sized = _table(spark, folder, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix_sizes(sized).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode_digests(_table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(_table(spark, folder, "conversations")).drop("place")


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination_report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_vectors, op2_license_scan, op3_tree_weighting, op4_language, op5_repeated_windows,
        op6_minhash, op7_toxicity, op8_mixing, op9_simhash, op10_bpe, op11_conversation_trie,
        op12_whitening, op13_decontamination,
    )
}
# Lower-cases A-Z only.
_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# crc32 of the digits and sign of a number: eight shifts a byte, the byte going in before the first.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]
        for c in string_split(conv_id::VARCHAR, '')])), lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END))"""
ORACLES: dict[str, str] = {
    "op1_near_vectors": """
        WITH RECURSIVE whole AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        usable AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM whole WHERE len(v) > 0 AND list_dot_product(v, v) > 0),
        pairs AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
            ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
        links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings LEFT JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)""",
    "op5_repeated_windows": f"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, s, w[s : s + {windows.WINDOW - 1}] AS part FROM docs, unnest(range(1, len(w) - {windows.WINDOW - 2})) t(s)),
        again AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY part ORDER BY doc_id, s) > 1),
        gone AS (SELECT doc_id, list(DISTINCT place) AS places FROM (SELECT doc_id, unnest(range(s, s + {windows.WINDOW})) AS place FROM again) GROUP BY doc_id),
        words AS (SELECT doc_id, len(w) AS n, coalesce(len(places), 0) AS removed, w, places FROM docs LEFT JOIN gone USING (doc_id)),
        marked AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place, places FROM words),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS left_ FROM marked WHERE places IS NULL OR NOT list_contains(places, place) GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_words, removed::BIGINT AS n_removed, sha256(coalesce(left_, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)""",
    "op11_conversation_trie": f"""
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS said FROM turns GROUP BY conv_id),
        headed AS (SELECT *, {_CRC} % 4 AS h FROM own),
        rebuilt AS (
            SELECT a.conv_id, coalesce(b.said, [])[1 : a.h] || a.said[a.h + 1 :] AS said
            FROM headed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
        members AS (SELECT conv_id, d AS depth, said[1 : d] AS prefix, d = len(said) AS ends FROM rebuilt, unnest(range(len(said) + 1)) t(d)),
        nodes AS (
            SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
            FROM members GROUP BY depth, prefix),
        linked AS (
            SELECT n.*, p.conv_id AS parent_conv_id,
                CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.prefix[-1].text, '[^\x20\x09-\x0D]+')) END AS saved
            FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1 : n.depth - 1]),
        kids AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL),
        named AS (SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN kids k USING (depth, conv_id)),
        below AS (
            SELECT t.d AS depth, prefix[1 : t.d] AS prefix, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
            FROM named, unnest(range(depth + 1)) t(d) GROUP BY ALL)
        SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
            b.saved::BIGINT AS saved_tokens, ends_sha256
        FROM named n JOIN below b USING (depth, prefix)""",
    "op13_decontamination": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM documents),
        items AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, least({decontamination.WINDOW}, len(w)) AS k, w[s : s + least({decontamination.WINDOW}, len(w)) - 1] AS part
            FROM items, unnest(range(1, len(w) - least({decontamination.WINDOW}, len(w)) + 2)) t(s) WHERE len(w) > 0),
        pieces AS (
            SELECT r, s, k, w[s : s + k - 1] AS part FROM docs, (SELECT DISTINCT k FROM windows) sizes, unnest(range(1, len(w) - k + 2)) t(s)),
        found AS (SELECT r, s, pieces.k, item FROM pieces JOIN windows USING (part)),
        hit AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(s, s + k)) AS place FROM found) GROUP BY r),
        named AS (
            SELECT r, count(item) AS n, coalesce(string_agg(item, ',' ORDER BY item), '') AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
}
