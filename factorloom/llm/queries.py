"""The operators' queries at production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, license_scan, packing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, token_output
from .common import shared_dir, tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.format_turns(rows.unionByName(chat_format.probe(spark))), in_order=True)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = shared_dir(spark) + "/ids"
    manifest = token_output.write(table(spark, sf_dir, "documents"), directory, tokenizer_path()).collect()
    return token_output.read(manifest, directory, spark)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1,
        "op2_license_scan": op2,
        "op3_chat_format": op3,
        "op4_pii": op4,
        "op5_decontaminate": op5,
        "op6_packing": op6,
        "op7_quality_rules": op7,
        "op8_quality_classifier": op8,
        "op9_token_output": op9,
        "op10_simhash": op10,
    }


_CHAT = r"""WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|') THEN len(regexp_extract_all(text, '<\\*\|')) ELSE 0 END AS more FROM t)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(SUM(length(role) + length(text) + more + 24) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


#: The tokens of a text, as decontaminate.templates has them, in both forms and as they stand.
_TOKENS = rf"""SELECT {{0}}, list_transform(w, lambda x: CASE WHEN x[1] = chr(1) THEN chr(3) WHEN x[1] BETWEEN '0' AND '9' THEN chr(2) WHEN x[1] <> lower(x[1]) THEN chr(1) ELSE lower(x) END) AS t,
list_transform(w, lambda x: CASE WHEN x[1] = chr(1) THEN chr(3) WHEN x[1] BETWEEN '0' AND '9' THEN chr(2) ELSE lower(x) END) AS p, list_transform(w, lambda x: lower(x)) AS r
FROM (SELECT DISTINCT {{0}}, string_split(trim(regexp_replace(regexp_replace(replace(COALESCE(text, ''), chr(1), ' '), '{decontaminate.MEASURE}', '\1 ' || chr(1) || '\2 ', 'g'), '[^\p{{{{L}}}}\p{{{{N}}}}\x01]+', ' ', 'g')), ' ') AS w FROM {{1}})"""
_WINDOWS = """SELECT {0}, f, list_transform(x[i : i + 4], lambda y: y IN (chr(1), chr(2), chr(3))) AS slot, array_to_string(x[i : i + 4], ' ') AS win, r[i : i + 4] AS r
FROM (SELECT {0}, f, CASE f WHEN 0 THEN t ELSE p END AS x, r, unnest(range(1, len(r) - 3)) AS i FROM {1}, range(2) g(f)) WHERE len(list_filter(x[i : i + 4], lambda y: y NOT IN (chr(1), chr(2), chr(3)))) >= 2"""
_LEAKS = f"""WITH d AS ({_TOKENS.format("doc_id", "documents")}), b AS ({_TOKENS.format("item_id", "benchmark")}),
bw AS ({_WINDOWS.format("item_id", "b")}), dw AS ({_WINDOWS.format("doc_id", "d")}),
n AS (SELECT item_id, f, COUNT(DISTINCT win) AS n FROM bw GROUP BY ALL),
hit AS MATERIALIZED (SELECT doc_id, item_id, f, win, bw.slot, bw.r AS x, dw.r AS y FROM dw JOIN bw USING (f, win)),
cov AS (SELECT doc_id, item_id, f, COUNT(DISTINCT win) / ANY_VALUE(n) AS coverage FROM hit JOIN n USING (item_id, f) GROUP BY ALL HAVING COUNT(DISTINCT win) / ANY_VALUE(n) >= {decontaminate.LEAST}),
s AS (SELECT doc_id, item_id, f, x[k] AS p, y[k] AS q FROM hit, range(1, 6) r(k) WHERE slot[k]),
con AS (SELECT doc_id, item_id, f, COUNT(DISTINCT p) / COUNT(DISTINCT p || ' ' || q) AS c FROM s GROUP BY ALL),
fine AS (SELECT doc_id, item_id, MAX(coverage) AS coverage FROM cov LEFT JOIN con USING (doc_id, item_id, f) WHERE COALESCE(c, 1) >= {decontaminate.LEAST} GROUP BY ALL),
ok AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, MAX(coverage) AS coverage FROM fine GROUP BY 1)
SELECT doc_id, n_items IS NOT NULL AS leaked, COALESCE(n_items, 0) AS n_items, COALESCE(item_ids, '') AS item_ids, COALESCE(coverage, 0) AS coverage FROM documents LEFT JOIN ok USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": _CHAT, "op5_decontaminate": _LEAKS}
