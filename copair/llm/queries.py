"""Thin queries over the given tables: one per operator, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copair.llm import (
    chat_events, cp_lsh, cube_mix, ffd_tournament, hd_langid, histogram_sort, merkle_rollup, packing, pii_crf, rp_forest,
    simhash_ring, spectrum_slicing, toxicity_gbt,
)
from copair.llm.common import crc_of, table

#: Path of the public tokenizer file; a parameter of the packing operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), TOKENIZER))


def op2_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii_crf.pii_column("text", pii_crf.learn(docs)).alias("p"))
    return found.select("doc_id", *[f"p.n_{k}" for k in pii_crf.KINDS], F.sha2(F.col("p.base"), 256).alias("base_sha256"),
                        "p.spans")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, plan = cube_mix.mix(table(spark, sf_dir, "documents"))
    sources = spark.createDataFrame([(s.index, s.size, s.target) for s in plan], "src int, source_size long, target double")
    return taken.join(F.broadcast(sources), "src").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        "copies")


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op5_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    events = chat_events.log_of_rows(rows.unionByName(fixed))
    return chat_events.read_back(chat_events.format_conversations(events))


def op6_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.pmod(crc_of("doc_id"), F.lit(5)) == 0
    model = toxicity_gbt.learn(docs.where(~held_out).join(labels, "doc_id"))
    score = toxicity_gbt.score_column("text", model)
    return docs.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op7_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return histogram_sort.shard(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), histogram_sort.byte_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(crc_of("doc_id"), F.lit(3)) == 1
    profiles = hd_langid.learn(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), hd_langid.predicted("text", profiles).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_ring.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=3)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         "component_id")


def op10_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp_lsh.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op11_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ffd_tournament.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*columns)
    low = merkle_rollup.lower_ascii(F.col("text"))
    other = merkle_rollup.hashed(*[merkle_rollup.field(low if c == "text" else F.col(c)) for c in columns])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit & (low != F.col("text")), other)
    found = merkle_rollup.manifest(docs, columns, tree="lang", order="doc_id", carry={"tampered": tampered})
    again = merkle_rollup.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle_rollup.proof_hash(F.col("path")).alias("proof_sha256"),
                        again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = spectrum_slicing.whiten(table(spark, sf_dir, "embeddings"))
    return white.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"),
                        "whitened", "explained", "identity_error")


QUERIES = {f.__name__: f for f in (
    op1_pack_sequences, op2_find_personal_data, op3_mix_sources, op4_nearest_vectors, op5_format_chats,
    op6_score_toxicity, op7_shard_by_bytes, op8_identify_language, op9_simhash_groups, op10_embedding_groups, op11_pack_tokens,
    op12_merkle_manifest, op13_whiten_embeddings)}

def _times(text: str, part: str) -> str:
    """SQL: how often ``part`` occurs in ``text``."""
    part = part.replace("'", "''")
    return f"(length({text}) - length(replace({text}, '{part}', ''))) // {len(part)}"


_ESCAPES = " + ".join(_times("text", c) for c in ("\\", *chat_events.CONTROL))
_FRAME = len(chat_events.TURN) + len(chat_events.END) + 2

#: Levels of the unrolled Merkle SQL: trees of up to 8 ** 6 leaves.
_LEVELS = 6


def _merkle_sql() -> str:
    """SQL: the tree of each lang and the tree over the langs, level by level."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = lambda text: " || ".join([value(c) for c in ("doc_id", "source", "lang", "n_chars")] + [value(text)])
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda a, z: {bit})"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, b: {byte}), 4294967295)"
    out = [f"""h AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256({fields('text')}) AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN sha256({fields(low)}) END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM h)"""]

    def tree(name: str, nodes: str, key: str) -> str:
        """The levels of the trees in ``nodes(key, i, h)``; gives the name of their top level."""
        out.append(f"{name}0 AS ({nodes})")
        for k in range(_LEVELS):
            runs = f"PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN"
            out.append(f"""{name}{k}p AS (
  SELECT *, count(*) OVER (PARTITION BY {key}) > 1 AS several,
         coalesce(string_agg(h, '') OVER ({runs} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(h, '') OVER ({runs} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name}{k}),
{name}{k + 1} AS (
  SELECT {key}, i // 8 AS i, CASE WHEN any_value(several) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
  FROM {name}{k}p GROUP BY {key}, i // 8)""")
        return f"{name}{_LEVELS}"

    sub = tree("s", "SELECT tree, rank AS i, leaf AS h FROM l", "tree")
    out.append(f"o AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank FROM {sub})")
    top = tree("t", "SELECT 0 AS one, rank AS i, subroot AS h FROM o", "one")
    levels = [f"s{k}p" for k in range(_LEVELS)] + [f"t{k}p" for k in range(_LEVELS)]
    joins, fold, proof = [], "coalesce(tampered, leaf)", []
    for k, name in enumerate(levels):
        k %= _LEVELS
        own = f"l.tree = {name}.tree AND l.rank // {8 ** k} = {name}.i" if name[0] == "s" else f"o.rank // {8 ** k} = {name}.i"
        joins.append(f"JOIN {name} ON {own}")
        proof.append(f"CASE WHEN {name}.several THEN {name}.lft || {name}.rgt ELSE '' END")
    steps = []
    for k, name in enumerate(levels):
        steps.append(f"f{k + 1} AS (SELECT *, CASE WHEN {name}_s THEN sha256({name}_l || c{k} || {name}_r) ELSE c{k} END AS c{k + 1} FROM f{k})")
    picked = ", ".join(f"{n}.several AS {n}_s, {n}.lft AS {n}_l, {n}.rgt AS {n}_r" for n in levels)
    out.append(f"""f0 AS (
  SELECT l.doc_id, l.leaf, o.subroot, {top}.h AS root, sha256({' || '.join(proof)}) AS proof_sha256, {fold} AS c0, {picked}
  FROM l JOIN o ON l.tree = o.tree CROSS JOIN {top} {' '.join(joins)})""")
    last = f"c{len(levels)}"
    return (f"WITH {', '.join(out + steps)} SELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, "
            f"{last} = root AS verified FROM f{len(levels)}")


#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op5_format_chats": f"""
WITH r AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_FRAME} + length(role) + length(text) + {_ESCAPES}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id""",
    "op10_embedding_groups": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
low AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT low.u AS vec_id, coalesce(n.n, 0) AS n_links, low.component_id, low.u = low.component_id AS kept
FROM low LEFT JOIN n ON low.u = n.u""",
    "op12_merkle_manifest": _merkle_sql(),
}
