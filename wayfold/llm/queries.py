"""The dealt operators as queries over whole tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode, load_model

    model = load_model(public_tokenizers.path("piece_bpe_32k.model"))
    return encode(_read(spark, sf_dir, "documents"), model, ids=False, check=True).drop("text_hash")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    out = token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    out = contaminated(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("bench_items") > 0).alias("contaminated"), "bench_items", "bench_share")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary_tokens import read_token_files, write_token_files

    uri = common.fresh_path(spark, "token-files")
    table = write_token_files(_read(spark, sf_dir, "documents"), uri, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, uri, table)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, simhash_components

    out = simhash_components(_read(spark, sf_dir, "documents"), words=4, distance=4)
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_languages

    return identify_languages(_read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_digest, license_scan

    return license_digest(license_scan(_read(spark, sf_dir, "documents"))).drop("spans")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import chat_digest, format_chats

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_digest(format_chats(turns))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster, cluster_digest

    return cluster_digest(*cluster(_read(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024, seed="3"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import align_tokens

    out = align_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_token_counts, op3_quality, op4_line_dedup, op5_embedding_dedup, op6_decontaminate, op7_token_files, op8_simhash, op9_language_id, op10_license_scan, op11_chat_format, op12_centroids, op13_token_alignment)}

_MARKS = {"system": ("[SYS]", "[+SYS]", "[/SYS]"), "user": ("[INST]", "[+INST]", "[/INST]"), "assistant": ("[OUT]", "[+OUT]", "</s>")}
_TAILS = r"s>|/s>|(?:/|\+)?SYS\]|(?:/|\+)?INST\]|\+?OUT\]|(?:/|\+|:)?ROLE\]"


def _chat_sql() -> str:
    def mark(k: int) -> str:
        own = " ".join(f"WHEN '{role}' THEN {len(m[k])}" for role, m in _MARKS.items())
        return f"CASE role {own} ELSE {('6 + 2 + 7 + length(said_role)', '7 + 2 + 7 + length(said_role)', '7')[k]} END"

    said = lambda c: f"regexp_replace({c}, '([<\\[])(\\\\*)({_TAILS})', '\\1\\\\\\2\\3', 'g')"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, {said("text")} AS said, {said("role")} AS said_role, lag(role) OVER w IS DISTINCT FROM role AS first, lead(role) OVER w IS DISTINCT FROM role AS last
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS a,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS b,
  CAST(3 + sum(CASE WHEN first THEN {mark(0)} ELSE {mark(1)} END + 1 + length(said) + 1 + CASE WHEN last THEN {mark(2)} ELSE 0 END) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(a) AS turns_sha256, length(b) AS loss_chars, sha256(b) AS loss_sha256, formatted_chars FROM d"""


def _centroid_sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    near = lambda c: f"SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN {c} c USING (i) GROUP BY v.r, c.c) GROUP BY r"
    steps = [f"""c0 AS MATERIALIZED (SELECT f.c, v.i, v.x FROM (SELECT r, row_number() OVER (ORDER BY h, xs) - 1 AS c FROM kept ORDER BY h, xs LIMIT {k}) f JOIN v USING (r))"""]
    for n in range(rounds):
        steps.append(f"""a{n} AS MATERIALIZED ({near(f"c{n}")})""")
        steps.append(f"""s{n} AS (SELECT a.c, v.i, sum(v.x) AS s, count(*) AS n FROM a{n} a JOIN v USING (r) GROUP BY a.c, v.i)""")
        steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.c, c.i, CAST(CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS BIGINT) AS x FROM c{n} c LEFT JOIN s{n} s ON s.c = c.c AND s.i = c.i)""")
    return f"""WITH raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = {width}),
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, list_transform(e, lambda x: CAST(floor(x * 1024) AS BIGINT)) AS xs
  FROM raw WHERE NOT list_bool_or(list_transform(e, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
v AS MATERIALIZED (SELECT r, unnest(range({width})) AS i, unnest(xs) AS x FROM kept),
{", ".join(steps)}, f AS MATERIALIZED ({near(f"c{rounds}")}),
said AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT kept.vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(f.d AS BIGINT) AS distance, CAST(sum(f.d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(f.d) OVER () AS BIGINT) AS inertia, said.h AS centroid_sha256
FROM f JOIN kept USING (r) JOIN said USING (c)"""


#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op5_embedding_dedup": """WITH RECURSIVE raw AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0),
flat AS (SELECT vec_id, label, len(e) AS size, list_bool_or(list_transform(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AS bad, list_transform(e, lambda x: coalesce(x, 0.0)) AS e FROM raw),
v AS (SELECT * FROM (SELECT vec_id, label, size, e, bad, sqrt(list_inner_product(e, e)) AS n FROM flat) WHERE NOT bad AND n > 0),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.size = b.size AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
ends AS (SELECT e.vec_id, coalesce(k.n, 0) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id FROM embeddings e
  LEFT JOIN (SELECT a, count(*) AS n FROM near GROUP BY 1) k ON k.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) c ON c.a = e.vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM ends""",
    "op11_chat_format": _chat_sql(),
    "op12_centroids": _centroid_sql(),
}
