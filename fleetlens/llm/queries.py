"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.bpe import decode_ids, encode_texts
from fleetlens.llm.chat import preference_pairs
from fleetlens.llm.exact_dedup import exact_duplicates
from fleetlens.llm.hnsw import near_vectors
from fleetlens.llm.language import fit_languages, held_out, predict_languages
from fleetlens.llm.license_texts import TEMPLATES
from fleetlens.llm.licenses import find_licenses
from fleetlens.llm.merkle import folded, merkle_manifest, proof_digest
from fleetlens.llm.minhash import near_duplicates
from fleetlens.llm.mixing import entropy_mix
from fleetlens.llm.packing import packed_documents
from fleetlens.llm.registry import ORACLES, QUERIES, query, table
from fleetlens.llm.sharding import contiguous_shards
from fleetlens.llm.toxicity import fit_toxicity, score_toxicity
from fleetlens.llm.trie import conversation_trie, numbered_turns, with_shared_heads

__all__ = ["ORACLES", "QUERIES"]


def preference_rows(conversations: DataFrame) -> DataFrame:
    """Chosen: each conversation. Rejected: its first ``conv_id mod 4`` turns, then those of its neighbour.

    The neighbour is the conversation whose id differs in the last bit only.
    """
    own, other = F.col("conv_id"), F.col("conv_id").bitwiseXOR(F.lit(1))
    places = F.array(
        F.struct(own.alias("pair_id"), F.lit("chosen").alias("side")),
        F.when(F.col("turn") < own % 4, F.struct(own.alias("pair_id"), F.lit("rejected").alias("side"))),
        F.when(F.col("turn") >= other % 4, F.struct(other.alias("pair_id"), F.lit("rejected").alias("side"))),
    )
    rows = conversations.select(F.explode(places).alias("place"), "turn", "role", "text")
    return rows.filter("place IS NOT NULL").select("place.*", "turn", "role", "text")


def _mask(side: str):
    """Characters of each segment and whether they are learned, as ``length:flag`` joined by blanks."""
    each = F.transform(side, lambda s: F.concat(F.length(s["text"]), F.lit(":"), s["loss"].cast("int")))
    return F.array_join(each, " ").alias(f"{side}_mask")


def _text(side: str):
    return F.array_join(F.col(side)["text"], "").alias(side)


_SIDE = """
           coalesce(string_agg('<|' || {s}_role || '|>' || chr(10) || {s}_text || '<|end|>' || chr(10), '' ORDER BY turn)
               FILTER (turn >= cut AND {s}_n > 0), '') AS {s},
           coalesce(string_agg((length({s}_role) + 5) || ':0 ' || (length({s}_text) + 8) || ':'
               || ({s}_role = 'assistant')::int, ' ' ORDER BY turn) FILTER (turn >= cut AND {s}_n > 0), '') AS {s}_mask"""


@query(
    "op1_preference_pairs",
    f"""
    WITH sides AS (
        SELECT conv_id AS pair_id, TRUE AS chosen, turn, role, text FROM conversations
        UNION ALL
        SELECT conv_id, FALSE, turn, role, text FROM conversations WHERE turn < conv_id % 4
        UNION ALL
        SELECT xor(conv_id, 1), FALSE, turn, role, text FROM conversations WHERE turn >= xor(conv_id, 1) % 4
    ), turns AS (
        SELECT pair_id, turn, count(*) FILTER (chosen) AS chosen_n, count(*) FILTER (NOT chosen) AS rejected_n,
               max(role) FILTER (chosen) AS chosen_role, max(text) FILTER (chosen) AS chosen_text,
               max(role) FILTER (NOT chosen) AS rejected_role, max(text) FILTER (NOT chosen) AS rejected_text
        FROM sides GROUP BY pair_id, turn
    ), cuts AS (
        SELECT *, coalesce(min(turn) FILTER (chosen_n <> rejected_n OR chosen_role <> rejected_role
                                             OR chosen_text <> rejected_text) OVER (PARTITION BY pair_id),
                           1 << 40) AS cut
        FROM turns
    )
    SELECT pair_id, (count(*) FILTER (turn < cut))::int AS n_prompt_turns,
           coalesce(string_agg('<|' || chosen_role || '|>' || chr(10) || chosen_text || '<|end|>' || chr(10), ''
               ORDER BY turn) FILTER (turn < cut), '') AS prompt,
           {_SIDE.format(s="chosen")},
           {_SIDE.format(s="rejected")}
    FROM cuts GROUP BY pair_id HAVING sum(chosen_n) > 0
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_pairs(preference_rows(table(spark, sf_dir, "conversations"))).filter("n_chosen_turns > 0")
    return pairs.select(
        "pair_id", "n_prompt_turns", "prompt", _text("chosen"), _mask("chosen"), _text("rejected"), _mask("rejected")
    )


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packed_documents(table(spark, sf_dir, "documents"), path, capacity=2048)


@query("op3_license_patience")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"), TEMPLATES)
    best = F.array_max(F.transform("found", lambda f: F.struct(f["coverage"], f["words"], f["license"], f["start"], f["end"])))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("found")["license"])), "|")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("found").alias("n_found"),
        names.alias("licenses"),
        F.col("best.license").alias("best_license"),
        F.col("best.coverage").alias("best_coverage"),
        F.col("best.start").alias("best_start"),
        F.col("best.end").alias("best_end"),
    )


@query("op4_hnsw_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query(
    "op5_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op6_ppm_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    trees = fit_languages(documents.filter(~held_out("doc_id", 3, 1)))
    found = predict_languages(documents, trees)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "bits")


@query("op7_bpe_round_trip")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = encode_texts(table(spark, sf_dir, "documents"), path)
    hashed = encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = decode_ids(hashed, path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_noisy_or_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 4, 2))
    found = score_toxicity(documents, fit_toxicity(documents, labels))
    return found.select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("offending").alias("offending_sentences"),
    )


@query("op9_minhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op10_minimax_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = contiguous_shards(table(spark, sf_dir, "documents"), shards=16)
    return shards.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 of a short ASCII text, bit by bit; DuckDB has no such function.
def crc32_sql(text: str) -> str:
    return f"""(xor(list_reduce(flatten(list_transform(string_split(CAST({text} AS VARCHAR), ''),
        lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda crc, c: CASE WHEN xor(crc, c) % 2 = 1
        THEN xor(xor(crc, c) >> 1, 3988292384) ELSE xor(crc, c) >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT))"""


def _framed(field: str) -> str:
    return f"coalesce(octet_length(encode(CAST({field} AS VARCHAR))) || ':' || {field}, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_framed(f) for f in ('doc_id', 'source', 'lang', 'n_chars', text))})"


@query(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
               CASE WHEN {crc32_sql('doc_id')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")}
                    ELSE {_leaf_sql('text')} END AS altered
        FROM documents
    ), placed AS (
        SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, altered) - 1 AS pos
        FROM leaves
    ), nodes AS (
        SELECT g, 0 AS level, pos, n, leaf AS digest FROM placed
        UNION ALL
        SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
        FROM nodes WHERE n > 1 GROUP BY g, level, pos // 3, n
    ), tops AS (
        SELECT -1 AS g, 0 AS level, g AS pos, count(*) OVER () AS n, digest FROM nodes WHERE n = 1
    ), upper AS (
        SELECT * FROM tops
        UNION ALL
        SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
        FROM upper WHERE n > 1 GROUP BY g, level, pos // 3, n
    ), everything AS (
        SELECT * FROM nodes UNION ALL SELECT * FROM upper
    ), siblings AS (
        SELECT a.g, a.level, a.pos,
               coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
               coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
        FROM everything a JOIN everything b ON a.g = b.g AND a.level = b.level AND a.pos // 3 = b.pos // 3
        WHERE a.n > 1 GROUP BY a.g, a.level, a.pos
    ), walk AS (
        SELECT g AS own, pos AS place, g, 0 AS level, pos, 0 AS step, altered AS node, '' AS proof FROM placed
        UNION ALL
        SELECT own, place, CASE WHEN s.g IS NULL THEN -1 ELSE w.g END, CASE WHEN s.g IS NULL THEN 0 ELSE w.level + 1 END,
               CASE WHEN s.g IS NULL THEN w.own ELSE w.pos // 3 END, step + 1,
               CASE WHEN s.g IS NULL THEN node ELSE sha256(s.l || node || s.r) END,
               CASE WHEN s.g IS NULL THEN proof ELSE proof || s.l || s.r END
        FROM walk w LEFT JOIN siblings s ON w.g = s.g AND w.level = s.level AND w.pos = s.pos
        WHERE s.g IS NOT NULL OR w.g >= 0
    ), ends AS (
        SELECT own, place, arg_max(node, step) AS folded_root, sha256(arg_max(proof, step)) AS proof_sha256
        FROM walk GROUP BY own, place
    )
    SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, proof_sha256, folded_root,
           folded_root = r.digest AS verified
    FROM placed p JOIN tops t ON p.g = t.pos JOIN ends e ON p.g = e.own AND p.pos = e.place
    CROSS JOIN (SELECT digest FROM upper WHERE n = 1) r
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tree = merkle_manifest(table(spark, sf_dir, "documents"), altered={"text": text})
    proof = tree.withColumn("folded_root", folded(F.col("path"), F.col("altered_leaf")))
    return proof.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query(
    "op11_conversation_trie",
    f"""
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql('conv_id')} % 6 AS h FROM turns GROUP BY conv_id
    ), rebuilt AS (
        SELECT c.conv_id, 0 AS part, d, role, text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE d <= h
        UNION ALL
        SELECT c.conv_id, 1, d, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE d > h
    ), whole AS (
        SELECT c.conv_id, coalesce(list(struct_pack(r := role, t := text) ORDER BY part, d) FILTER (d IS NOT NULL), []) AS seq
        FROM convs c LEFT JOIN rebuilt USING (conv_id) GROUP BY c.conv_id
    ), steps AS (
        SELECT conv_id, unnest(range(len(seq) + 1)) AS depth, seq FROM whole
    ), nodes AS (
        SELECT seq[:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               (count(*) - 1) * coalesce(length(any_value(seq[depth].t)), 0) AS saves,
               coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = len(seq)), '') AS ends
        FROM steps GROUP BY prefix, depth
    ), parents AS (
        SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p
        ON p.depth = n.depth - 1 AND p.prefix = n.prefix[:n.depth - 1]
    ), kids AS (
        SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children
        FROM parents WHERE depth > 0 GROUP BY ALL
    ), facts AS (
        SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN kids USING (conv_id, depth)
    ), ancestors AS (
        SELECT prefix[:up] AS prefix, up AS depth, saves, n_children
        FROM (SELECT *, unnest(range(depth + 1)) AS up FROM facts)
    ), sums AS (
        SELECT prefix, depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves)::BIGINT AS saved_tokens
        FROM ancestors GROUP BY prefix, depth
    )
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
    FROM facts JOIN sums USING (prefix, depth)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(*with_shared_heads(numbered_turns(table(spark, sf_dir, "conversations"))))


@query("op13_entropy_mix")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "rate", "copies"
    )
