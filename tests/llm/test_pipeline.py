import sys
from pathlib import Path

from helpers import docs

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from test_decontam import plain  # noqa: E402
from test_simhash import kept_by_brute_force  # noqa: E402

from fleetpulse.llm import mixing  # noqa: E402


def staged(spark, table, sf):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        table = spark.createDataFrame(stage(spark, table, sf).collect(), stage(spark, table, sf).schema)
        out.append(table)
    return out


def test_every_stage_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    source = table.collect()
    extra = [(900, None, "en", "s", 0), (901, "12 34", "en", "s", 5), (902, "and " + items[0].upper() + " so", "en", "src0", 1)]
    table = table.unionByName(spark.createDataFrame(extra, table.schema))
    known, unique, clean, mixed, sharded = staged(spark, table, sf)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(known) == sorted([r["doc_id"] for r in source if any(c.isalpha() for c in r["text"])] + [902])
    rows = sorted(known.collect(), key=lambda r: r["doc_id"])
    assert ids(unique) == [rows[i]["doc_id"] for i in kept_by_brute_force([r["text"] for r in rows])]
    want = [r["doc_id"] for r in unique.collect() if not any(plain(i) in plain(r["text"]) for i in items)]
    assert ids(clean) == sorted(want) and 902 not in want
    times = {r["doc_id"]: 0 for r in clean.collect()}
    for r in mixed.collect():
        times[r["doc_id"]] += 1
    want = {r["doc_id"]: 0 for r in clean.collect()}
    for r in mixing.replicate(clean).collect():
        want[r["doc_id"]] += 1
    assert times == want
    assert mixed.columns == table.columns and sharded.columns == [*table.columns, "shard"]
    assert ids(sharded) == ids(mixed) and all(0 <= r["shard"] < 40 for r in sharded.collect())


def test_stages_take_odd_rows_and_no_rows(spark, sf):
    odd = docs(spark, [None, "", "a", "word " * 20000, "a", "A"]).unionByName(
        spark.createDataFrame([(None, None, None, None, None)] * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    )
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, table, sf)
            assert kept.columns[: len(table.columns)] == table.columns and kept.count() >= 0
