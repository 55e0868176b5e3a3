"""Secret scans: fixed rules, and character Markov models that tell random strings from ordinary identifiers.

Two first-order models, one of random strings and one of identifiers, are counted from labelled samples. A token
whose log-likelihood ratio is large enough is a secret. Everything is DataFrame code: places of matches are
column expressions, distinct tokens are scored by joining their character pairs with the table of ratios, which
has one row per pair of the alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import attach, placed
from fleetpulse.llm.pii import joined, matches
from fleetpulse.plans.tables import materialize

# Base kinds in their order, then the kind this method adds.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Only keys of 16 and runs of 32 characters count; asking for them at once finds the same ones.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
# Tokens to score: 16 characters or more with a digit and a letter among them.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
# Least log-likelihood ratio of a token, in nats, and least mean per character pair.
LEAST_RATIO, LEAST_MEAN = 8.0, 0.4
# Expected number of documents whose words make the sample of ordinary identifiers.
SAMPLE_DOCS = 20_000
PRIOR = 10.0
RUNS = 256
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,text:string>>"


def _spans(kind: str, found: Column) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            (m["start"] + F.length(m["text"])).alias("end"), m["text"].alias("text"),
        ),
    )


def base_spans(text: Column) -> Column:
    """Spans of the fixed rules, by start and kind."""
    none = F.expr(f"CAST(array() AS {SPAN})")
    long = lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 1)) >= 8
    assign = F.when(text.rlike(ASSIGN), _spans("assign", F.filter(matches(text, ASSIGN.replace("([A", "(?:[A")), long))).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _spans("access", matches(text, ACCESS))).otherwise(none)
    runs = F.when(text.rlike(HEX), _spans("hex", matches(text, HEX))).otherwise(none)
    return F.sort_array(F.concat(assign, access, runs))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _base, _tokens, _run, _file, _line): written once; tokens that overlap a base span are left out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_base", base_spans(F.col("_text")))
    tokens = F.when(F.col("_text").rlike(TOKEN), _spans("random", matches(F.col("_text"), TOKEN))).otherwise(F.expr(f"CAST(array() AS {SPAN})"))
    apart = lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    rows = rows.withColumn("_tokens", tokens).select("_id", "_base", F.filter("_tokens", apart).alias("_tokens"))
    return placed(materialize(rows, "secrets"), RUNS)


def identifier_sample(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(token): words of about ``sample_docs`` documents, or of all if there are fewer, without base matches."""
    size = docs.count()
    share = min(1.0, sample_docs / size) if size else 1.0
    draw = F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < int(share * (1 << 30))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(clean, F.lit("([A-Za-z0-9+/_=.-]{4,})"), F.lit(1))
    return docs.where(draw | F.lit(share >= 1.0)).select(F.explode(words).alias("token"))


def random_sample(scanned: DataFrame) -> DataFrame:
    """(token): the values of base spans, and a base64 digest of the id of every row."""
    value = F.when(F.col("s.kind") == "assign", F.regexp_extract("s.text", ASSIGN, 1)).otherwise(F.col("s.text"))
    found = scanned.select(F.explode("_base").alias("s")).select(value.alias("token"))
    return found.unionByName(scanned.select(F.base64(F.unhex(F.sha2(F.coalesce(F.col("_id").cast("string"), F.lit("")), 256))).alias("token")))


def pairs(tokens: DataFrame, *keep: str) -> DataFrame:
    """One row per pair of neighbouring characters of ``token``."""
    pair = F.expr("explode(transform(sequence(1, length(token) - 1), i -> substring(token, i, 2)))")
    return tokens.where(F.length("token") > 1).select(*keep, pair.alias("pair"))


def fit_ratios(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """(pair, ratio) for every pair of the alphabet: the log of the two models' transition probabilities.

    A transition is smoothed by the frequency of its second character, which weighs as PRIOR observations.
    """
    spark = random.sparkSession
    counted = (
        pairs(random.select("token", F.lit("r").alias("label")), "label")
        .unionByName(pairs(ordinary.select("token", F.lit("o").alias("label")), "label"))
        .groupBy("pair")
        .agg(F.count(F.when(F.col("label") == "r", 1)).alias("r"), F.count(F.when(F.col("label") == "o", 1)).alias("o"))
    )
    grid = spark.createDataFrame([(a + b,) for a in ALPHABET for b in ALPHABET], "pair string")
    filled = grid.join(counted, "pair", "left").fillna(0)
    filled = filled.select("pair", "r", "o", F.substring("pair", 1, 1).alias("first"), F.substring("pair", 2, 1).alias("second"))
    sums = lambda by, r, o: filled.groupBy(by).agg(F.sum("r").alias(r), F.sum("o").alias(o))
    single = sums("second", "r2", "o2").withColumn("rn", F.sum("r2").over(Window.partitionBy(F.lit(0))))
    single = single.withColumn("on", F.sum("o2").over(Window.partitionBy(F.lit(0))))  # one row per character
    size = len(ALPHABET)

    def chance(pair: str, first: str, second: str, total: str) -> Column:
        alone = (F.col(second) + 1) / (F.col(total) + size)
        return (F.col(pair) + PRIOR * alone) / (F.col(first) + PRIOR)

    ratio = F.log(chance("r", "rs", "r2", "rn")) - F.log(chance("o", "os", "o2", "on"))
    return filled.join(sums("first", "rs", "os"), "first").join(single, "second").select("pair", ratio.alias("ratio"))


def score_tokens(tokens: DataFrame, ratios: DataFrame) -> DataFrame:
    """(token, ratio, mean) of the distinct tokens."""
    # At most len(ALPHABET) squared rows.
    joined_pairs = pairs(tokens.select("token").distinct(), "token").join(F.broadcast(ratios), "pair")
    return joined_pairs.groupBy("token").agg(F.sum("ratio").alias("ratio"), F.avg("ratio").alias("mean"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, out: str = "spans") -> DataFrame:
    """(id, ``out``): all spans of each row with start, kind, end (exclusive, code points) and text, by start and kind.

    ``samples`` (token, is_secret) trains the models; by default they learn from the base matches, digests of the
    ids, and words of the documents. Null texts count as empty; repeated rows are each reported.
    """
    scanned = scan(docs, id_col, text_col)
    if samples is None:
        random, ordinary = random_sample(scanned), identifier_sample(docs, text_col)
    else:
        random, ordinary = samples.where("is_secret"), samples.where("NOT is_secret")
    ratios = materialize(fit_ratios(random, ordinary), "ratios")
    tokens = scanned.select("_file", "_line", "_run", F.explode("_tokens").alias("_span")).withColumn("token", F.col("_span.text"))
    scores = score_tokens(tokens, ratios).where((F.col("ratio") >= LEAST_RATIO) & (F.col("mean") >= LEAST_MEAN))
    added = attach(tokens, scores, ["token"]).where(F.col("ratio").isNotNull()).groupBy("_file", "_line").agg(F.collect_list("_span").alias("_added"))
    every = F.sort_array(F.concat("_base", F.coalesce("_added", F.expr(f"CAST(array() AS {SPAN})"))))
    return scanned.join(added, ["_file", "_line"], "left").select(F.col("_id").alias(id_col), every.alias(out))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans and all spans of every row of ``docs``."""
    rows = find_secrets(docs, out="_spans")
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE))
    return rows.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"), count("random")
    )
