import os

import duckdb
import pytest

import corpus_pipeline
from nearfield.llm import registry

DATA = os.environ.get("NEARFIELD_TEST_DATA", "/root/testdata/sf0.001")


def test_every_stage_keeps_columns_and_takes_effect(spark):
    good = [" ".join(f"w{k}of{n}" for k in range(120)) + "." for n in range(12)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(good)]
    rows += [(50, good[0], "en", "s0", 1), (51, good[1].replace("w33of1", "x"), "en", "s1", 1), (52, "too short.", "en", "s1", 1), (None, None, None, None, None), (2, good[2], "en", "s2", len(good[2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        seen.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen[:3] == [("quality_rules", 15), ("exact_dedup", 13), ("near_dedup", 12)]
    assert docs.agg({"length": "sum"}).first()[0] > 0


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, expected = registry.queries()[name](spark, DATA).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    norm = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist()))
    assert norm(got) == norm(expected)


CLASHING = "_sha _stay _k0 _chars _rows _d _s _n _copies _values _doc key key_ n total number usual usual_source digest row line words mix_n mix_total copies component stays size rank block p".split()


def test_columns_of_any_name_and_type_pass_every_stage(spark):
    """Names that operators use themselves, a map, repeated rows, null ids, ids beyond 2^53 and one very long text."""
    from pyspark.sql import functions as F

    texts = [" ".join(f"w{k}of{n}" for k in range(90)) + "." for n in range(6)]
    texts.append("\n".join(" ".join(f"l{k}n{n}" for k in range(40)) + "." for n in range(2500)))
    big = 2**60 + 1
    rows = [(k + big, t, "en", f"s{k % 2}") for k, t in enumerate(texts)]
    rows += [(big, texts[0], "en", "s0"), (90, texts[1] + " ", "en", "s1"), (91, texts[2].replace("w7of2", "x"), "en", None), (None, texts[3], None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", F.length("text").cast("long").alias("n_chars"), *(F.lit(f"own {c}").alias(c) for c in CLASHING), F.create_map(F.lit("a"), F.lit(1)).alias("map"))
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
        found = docs.collect()
        left[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found)
        assert all(r[c] == f"own {c}" for r in found for c in CLASHING) and all(r["map"] == {"a": 1} for r in found)
        docs = spark.createDataFrame(found, docs.schema)
    assert left["quality_rules"] == sorted([(False, k + big) for k in range(7)] + [(False, big), (False, 90), (False, 91), (True, 0)])
    assert left["near_dedup"] == sorted((False, k) for k in [big, 90, 91, *(k + big for k in (3, 4, 5, 6))])
    assert {k for _, k in left["mixing"]} <= {k for _, k in left["near_dedup"]}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in pieces} == {k for _, k in left["mixing"]}


def test_null_ids_leave_large_ids_exact(spark):
    from nearfield.llm import mixing

    big = 2**60 + 1
    docs = spark.createDataFrame([(None, "a b c", "s"), *((big + k, "a " * (k + 1), "s") for k in range(5))], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] or 0 for r in mixing.mix(docs).collect()) == [0, *(big + k for k in range(5))]
