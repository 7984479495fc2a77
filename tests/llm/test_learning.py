"""Fill-in-middle, quality classifier and importance resampling against brute force."""

import hashlib
import math
import os
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from nearfield.llm import fill_in_middle as fim
from nearfield.llm import importance_resampling as resampling
from nearfield.llm import quality_classifier as quality
from nearfield.llm.text_bytes import slices, text_bytes

DATA = "/root/testdata/sf0.001"
EXTRA = ", n int, form string, output string, row int, bucket int, w string, score string, trusted int, gain int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1, "f", "o", 2, 3, "w", "s", 4, 5) for k, t in rows], "doc_id long, text string" + EXTRA)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


def sql_rows(sql, tables):
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con.sql(sql)


# fill in middle


def naive_fim(doc_id, text, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "a", "a\nb", "a\nb\n", "<P", "<S", "a<P>b", "<", "<<P>", "<P\n>\n<S\n", "é<M>", "ü\nñß\n€\U0001f600\n", "a\x00b\nc", "\r\n\x0b\n"]
    texts += ["".join(rng.choice(["<", "P", "S", "M", ">", "\n", "x", "é", "\U0001f600"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    return texts + ["long line " * 300_000, "short\n" * 400_000]


def test_fill_in_middle_equals_brute_force(spark):
    texts = odd_texts()
    rows = [*enumerate(texts), (3, "a\nb\nc"), (3, "a\nb\nc"), (None, "a\nb\nc\nd")]
    got = fim.restore(fim.transform(frame(spark, rows).repartition(5))).collect()
    found = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]) for r in got)
    assert found == Counter((k, *naive_fim(k, t), t or "") for k, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_edges(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert fim.restore(fim.transform(empty)).count() == 0
    rare = fim.FillInMiddle(percent=0)
    assert [r["form"] for r in fim.transform(frame(spark, [(1, "a\nb")]), rare).collect()] == ["plain"]
    other = fim.FillInMiddle(prefix=b"[[pre]]", suffix="⟂".encode(), middle=b"\x00m")
    rows = [(k, t) for k, t in enumerate(["a\nb\nc", "[[pre]\nx", "a⟂b", "[[pre]]", None])]
    assert sorted((r["doc_id"], r["text"]) for r in fim.restore(fim.transform(frame(spark, rows), other), other).collect()) == [(k, t or "") for k, t in rows]
    for bad in ({"prefix": b""}, {"prefix": b"<S>"}, {"prefix": b"<", "suffix": b"<S>"}, {"middle": b">x<"}, {"prefix": b"\xff"}, {"prefix": b"x" * 300}):
        with pytest.raises(ValueError):
            fim.FillInMiddle(**bad).automaton


@pytest.mark.parametrize("block, lane", [(64, 4), (1 << 20, 256), (7, 3)])
def test_lanes_equal_one_scan(monkeypatch, block, lane):
    monkeypatch.setattr(fim, "BLOCK", block)
    monkeypatch.setattr(fim, "LANE", lane)
    automaton = fim.Automaton((b"<P>", b"<<SS", b"\xc3\xa9"))
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"<PS>x\n\xc3\xa9\xff", np.uint8), 1000)
    state_of, meaning_of = automaton.table
    state, expected = 0, []
    for byte in data.tolist():
        expected.append(meaning_of[state * 256 + byte])
        state = int(state_of[state * 256 + byte])
    assert automaton.scan(data).tolist() == expected


def test_fill_in_middle_sql(spark):
    assert rows_of(fim.op11_fill_in_middle(spark, DATA).toPandas()) == rows_of(sql_rows(fim.OP11_SQL, ["documents"]).df())


def test_slices_hold_whole_texts():
    batch = pa.RecordBatch.from_pydict({"text": ["ab", None, "", "é" * 50, "x", "yz"]}).slice(1)
    parts = list(slices(iter([batch, batch.slice(0, 0)]), "text", 10))
    assert [p.column("text").to_pylist() for p, _, _ in parts] == [[None, ""], ["é" * 50], ["x", "yz"]]
    assert [bytes(data) for _, data, _ in parts] == [b"", ("é" * 50).encode(), b"xyz"]
    assert text_bytes(pa.array([None, None], pa.large_string()))[1].tolist() == [0, 0, 0]


# quality


def good(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 80))).capitalize() + "."


def bad(rng):
    words = good(rng).split()
    return rng.choice([" | ".join, lambda w: " ".join(w).upper().replace(" ", "!! "), lambda w: "### ".join(w)])(words)


def corpus(n=600):
    rng = random.Random(3)
    docs = [(k, good(rng) if k % 5 else bad(rng)) for k in range(n)]
    return docs, [(k, int(k % 5 > 0)) for k in range(n)]


def test_statistics_equal_brute_force(spark):
    docs, _ = corpus(60)
    docs += [(None, "a"), (61, None), (62, ""), (3, docs[3][1]), (63, "word " * 100_000)]
    s = quality.gather(frame(spark, docs).repartition(7), spark.createDataFrame([(3,), (62,), (99,)], "doc_id long"))
    data, at = text_bytes(pa.array([t for _, t in docs]))
    x = quality.features(data, at)
    trusted = x[[k in (3, 62) for k, _ in docs]]
    assert (s.n_all, s.n_positive) == (65, 3)
    assert np.allclose(s.all, x.T @ x) and np.allclose(s.positive, trusted.T @ trusted)
    assert x.shape[1] == quality.WIDTH and np.isfinite(x).all()


def test_quality_learns_from_positives_alone(spark):
    docs, labels = corpus()
    docs += [(1000, None), (1001, ""), (None, docs[1][1]), (1, docs[1][1])]
    table = spark.createDataFrame([*labels, (2000, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(frame(spark, docs), table)
    got = quality.score_quality(frame(spark, docs), model).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    unseen = [k for k, _ in labels if crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(score[k] >= 0.5) == (k % 5 > 0) for k in unseen]) >= 0.95
    assert 0.6 < model.prior < 0.95
    only = quality.train(frame(spark, docs), table.where("quality = 1"))
    assert np.array_equal(only.weights, model.weights)  # labels of 0 play no part
    changed = table.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert np.array_equal(quality.train(frame(spark, docs), changed).weights, model.weights)  # nor do held-out ones


def test_risk_is_never_negative():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(4000), rng.normal(size=(4000, 5))])
    x[:3000, 1] += 3
    p = x[:1000]
    s = quality.Statistics(4000.0, x.T @ x, 1000.0, p.T @ p)
    for prior in (0.3, 0.75, 0.9, 0.99):
        w = quality.minimise(s, prior)
        loss = lambda m: (1 + 2 * m.mean(axis=0) @ w + ((m @ w) ** 2).mean()) / 4  # noqa: E731, B023
        assert loss(x) - prior * loss(p) >= -1e-9
    assert ((x @ quality.minimise(s, 0.75) >= 0) == (np.arange(4000) < 3000)).mean() > 0.9


def test_quality_edges(spark):
    docs, labels = corpus(50)
    none = spark.createDataFrame([], "doc_id long, quality int")
    text = frame(spark, docs)
    assert {r["score"] for r in quality.score_quality(text, quality.train(text, none)).collect()} == {0.5}
    zeros = spark.createDataFrame([(k, 0) for k, _ in labels], "doc_id long, quality int")
    assert max(r["score"] for r in quality.score_quality(text, quality.train(text, zeros)).collect()) < 0.01
    empty = text.limit(0)
    assert quality.score_quality(empty, quality.train(empty, spark.createDataFrame(labels, "doc_id long, quality int"))).count() == 0


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    got = quality.op12_quality_classifier(spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    unseen = got[got.held_out]
    assert len(unseen) > 50 and (unseen.predicted == unseen.quality).mean() >= 0.97


# importance resampling


def naive_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def naive_resample(docs, target, percent=5, least=20, seed=42, buckets=10_000):
    def bag(text):
        w = naive_words(text)
        return Counter(crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1))

    bags = [bag(t) for _, t in docs]
    s, t = sum(bags, Counter()), sum((bag(x) for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (k, text), own in zip(docs, bags):
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in own.items())
        rows.append([k, sum(own.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(naive_words(text)) >= least])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    out = [tuple(r[:4]) + (n if n <= int(percent * len(fit) // 100) else None,) for n, r in enumerate(fit, 1)]
    return Counter(out + [tuple(r[:4]) + (None,) for r in rows if not r[4]])


def test_resampling_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["The", "CAT", "sat", "É", "été", "Straße", "x1", "2", "İ", "ÀB", "日本", "dog"]
    docs = [(k, rng.choice([" ", ", ", "\n", "--", "\x7f"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for k in range(200)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (6, "other text " * 15), (None, "the cat " * 20), (None, None), (300, None), (301, ""), (302, ".,;"), (303, "one"), (304, "one two"), (305, "the cat sat on it " * 20_000)]
    target = ["the cat sat", None, "", "The CAT sat on the dog", "été"]
    texts = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, bucket int")
    got = resampling.resample(frame(spark, docs).repartition(6), texts, percent=30)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == naive_resample(docs, target, percent=30)
    assert got.where("rank is not null").count() == 30 * sum(len(naive_words(t)) >= 20 for _, t in docs) // 100


def test_resampling_edges(spark):
    docs = [(k, "a b c " * 10) for k in range(40)]
    none = spark.createDataFrame([], "item_id long, text string")
    got = resampling.resample(frame(spark, docs), none, percent=100)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == naive_resample(docs, [], percent=100)
    assert resampling.resample(frame(spark, docs).limit(0), none).count() == 0
    with pytest.raises(ValueError):
        resampling.resample(frame(spark, docs), none, buckets=0)


def test_resampling_sql(spark):
    expected = sql_rows(resampling.OP13_SQL, ["documents", "benchmark"]).fetchall()
    got = resampling.op13_importance_resampling(spark, DATA)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == Counter(expected)
