"""The registered corpus queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.llm import collocations, decontam, exact, fim, katz, langid, licenses, mixing, pii, repeats, secrets, sharding, simhash
from fleetpulse.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


CRC_CTES = """tbl AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1],
  lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""


def race_sql(shards: int) -> str:
    digests = -(-shards // 4)
    digest = lambda g: f"md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|{g}')"
    draw = lambda s: f"(CAST('0x' || substr(m[{s // 4 + 1}], {s % 4 * 8 + 1}, 8) AS BIGINT) + 0.5) / 4294967296.0"
    timed = ", ".join(f"{{'t': -ln({draw(s)}), 's': {s}}}" for s in range(shards))
    return f"SELECT *, [{timed}] AS races FROM (SELECT *, [{', '.join(digest(g) for g in range(digests))}] AS m FROM sized)"


@query(
    "op7_rendezvous_shards",
    f"""WITH {CRC_CTES},
sized AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(tbl.crc[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8)), 4294967295) AS text_crc32 FROM documents, tbl),
raced AS ({race_sql(41)}),
placed AS (SELECT doc_id, size, text_crc32, list_min(races[1:40]).s AS shard, list_min(races).s AS grown_shard FROM raced)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', doc_id, size, text_crc32, 'key', grown_shard)), doc_id, size, text_crc32) - 1 AS slot,
  grown_shard FROM placed""",
)
def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(read_table(spark, sf_dir, "documents"))


@query(
    "op8_exact_dedup",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS n FROM documents),
w AS (SELECT doc_id, sha256(n) AS text_sha256, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id,
  count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w""",
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents"))


@query(
    "op10_poisson_mix",
    f"""WITH d AS (SELECT *, coalesce(source, '{mixing.UNKNOWN}') AS src, greatest(octet_length(encode(coalesce(text, ''))), 1) AS b FROM documents),
z AS (SELECT src, sum(b) AS b, pow(CAST(sum(b) AS DOUBLE), {mixing.TEMPERATURE}) AS share FROM d GROUP BY src),
r AS (SELECT src, share / sum(share) OVER () * CAST(sum(b) OVER () AS DOUBLE) / b AS rate FROM z),
k AS (SELECT src, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 60) AS INT) + 1)) AS k FROM r),
p AS (SELECT src, k, exp(k * ln(rate) - rate - sum(ln(greatest(k, 1))) OVER (PARTITION BY src ORDER BY k)) AS p FROM k),
c AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS upto FROM p),
s AS (SELECT src, list(upto ORDER BY k) AS steps FROM c GROUP BY src),
u AS (SELECT d.*, len(list_filter(steps, lambda x: x <= (CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5)
  / 4503599627370496.0)) AS times FROM d JOIN s USING (src)),
e AS (SELECT *, unnest(range(1, times + 1)) AS copy FROM u)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy, md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy) AS mix_key FROM e""",
)
def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(read_table(spark, sf_dir, "documents"))


@query("op3_simhash_vantage")
def op3_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


@query("op4_hyperdimensional_language")
def op4_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query("op2_qgram_decontamination")
def op2_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_report(read_table(spark, sf_dir, "documents"))


@query("op6_secrets_markov")
def op6_secrets_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read_table(spark, sf_dir, "documents"))


@query("op1_license_templates")
def op1_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read_table(spark, sf_dir, "documents"))


@query("op9_katz_backoff")
def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.language_report(read_table(spark, sf_dir, "documents"))


UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@query(
    "op12_fill_in_middle",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNITS}') AS u,
  sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= {fim.FIM_PERCENT} THEN 'plain'
    WHEN r[4] % 100 < {fim.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""",
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(read_table(spark, sf_dir, "documents"))


@query("op11_prefix_free_repeats")
def op11_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_report(read_table(spark, sf_dir, "documents"))


@query("op13_toivonen_collocations")
def op13_toivonen_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))
