"""Importance resampling towards a target text, in Spark SQL only.

Every document and every target text is a bag of hashed n-grams (DSIR, Xie et
al. 2023). What a bucket's share in the target gains over its share in the
corpus, in thousandths of a logarithm, is a whole number; a document's weight is
the sum over its features. Adding Gumbel noise to the weights and keeping the
highest scores draws without replacement with probabilities in proportion to
the exponentiated weights.

Features are exploded where a text is read. Shuffled are only bucket counts of
each task, one short row per document, and the candidates' scores for the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import own, table, written

#: What stands between words, A-Z being lower case already.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BUCKETS, LONGEST = 10_000, 3
#: Buckets at most, so that the table of gains stays small enough to broadcast.
MOST_BUCKETS = 1 << 22
LEAST_WORDS, SEED, PERCENT = 20, 42, 5
_TWO32 = 4294967296.0


def words(text: Column) -> Column:
    """The words of a text with A-Z (only) lower-cased; null has none."""
    plain = F.octet_length(text) == F.char_length(text)  # then lower() changes A-Z only, and is much faster
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATOR), "")


def features(rows: DataFrame, text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """A row for each n-gram: the other columns of its text's row, ``more`` (its words beyond the first) and ``bucket``.

    A text of any length is one array of words and as many exploded rows as it
    has n-grams; n-grams never cross texts. A text without words has one row
    with a null bucket.
    """
    keep = [c for c in rows.columns if c != text]
    split = rows.select(*keep, words(F.col(text)).alias("w"))
    shifted = [F.slice("w", F.lit(n + 1), F.greatest(F.size("w") - n, F.lit(0))).alias(f"w{n}") for n in range(longest)]
    beside = split.select(*keep, F.inline_outer(F.arrays_zip(*shifted)))
    grams = [F.concat(*[x for n in range(size) for x in (F.lit(" "), F.col(f"w{n}"))][1:]) for size in range(1, longest + 1)]  # null beyond the end
    hashed = [F.pmod(F.crc32(g.cast("binary")), F.lit(buckets)).cast("int") for g in grams]
    return beside.select(*keep, F.posexplode(F.array(*hashed)).alias("more", "bucket")).where(F.col("bucket").isNotNull() | (F.col("more") == 0))


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket and n over all texts; a task sends one row per bucket at most."""
    return features(own(texts, text=text_col), "text", buckets, longest).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """gain of every bucket in thousandths: the logarithm of its smoothed share in the target over that in the corpus.

    Both inputs are bucket and n. Every bucket has a row, also of empty tables.
    """
    counted = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    each = counted.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    each = written(each, "bucket-counts")
    all_s, all_t = each.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    ratio = ((F.col("t") + 1) * F.lit(all_s + buckets)) / ((F.col("s") + 1) * F.lit(all_t + buckets))
    return each.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def document_weights(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row.

    Rows are told apart by their place in the input, so repeated ids stay
    apart; ``docs`` is read once, and should be a table or else deterministic. ``gain`` has one row per bucket, at most MOST_BUCKETS, and is broadcast.
    """
    rows = own(docs, doc_id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    found = features(rows, "text", buckets, longest).join(F.broadcast(gain), "bucket", "left")
    n_words = F.count_if((F.col("more") == 0) & F.col("bucket").isNotNull())
    summed = found.groupBy("row", "doc_id").agg(n_words.alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    return summed.drop("row")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id; a null id hashes like an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(_TWO32)))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """The rows with their place (``rank``, from 1) in that order, and how many there are.

    The sort is by range over all tasks. Each sorted part is written with the
    number of its part and the row's place in it; what comes before a part is
    added from the parts' sizes, one short row for each.
    """
    id_ = F.monotonically_increasing_id()
    at = rows.orderBy(*order).withColumn("place", id_)
    at = written(at, "ranked")
    part = F.shiftright("place", 33)
    sizes = sorted(tuple(r) for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row per part of the sort
    before, offsets = 0, []
    for number, n in sizes:
        offsets.append((number, before))
        before += n
    table_ = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    out = at.withColumn("part", part).join(F.broadcast(table_), "part")
    rank = F.col("before") + F.col("place") - F.shiftleft(F.col("part"), 33) + 1
    return out.select(*rows.columns, rank.alias("rank")), before


def resample(
    docs: DataFrame, target: DataFrame, percent: float = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; rank is null for what isn't drawn.

    Drawn are, of the N rows with at least ``least_words`` words, the floor of
    ``percent`` * N / 100 highest scores; ties go to the smaller id (a null id
    comes last), then to fewer features and the smaller weight, so that only
    equal rows can change places. A null or empty text has no features and
    weighs 0. Without target texts, or without documents, all shares are those
    of the smoothing. Other columns, whatever their names, are left aside.
    """
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
    corpus = bucket_counts(docs, text_col, buckets, longest)
    gain = gains(corpus, bucket_counts(target, target_col, buckets, longest), buckets)
    scored = document_weights(docs, gain, id_col, text_col, buckets, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "scores")
    fit = F.col("n_words") >= least_words
    columns = ["doc_id", "n_features", "weight", "score"]
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    places, n = ranked(scored.where(fit).select(*columns), order)
    drawn = int(percent * n // 100)
    rest = scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))
    return places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weights towards the benchmark's texts, and the ranks of those drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FEATURES = """(SELECT id, w, array_to_string(w[i:i + k - 1], ' ') AS f, k FROM {0}, range(1, 4) g(k), range(1, len(w) - k + 2) h(i))"""
#: Words, n-grams and counts as in Spark; crc32 by its table of 256 entries, made by the rule.
OP13_SQL = f"""
WITH tab AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n) ORDER BY n) AS t FROM range(256) r(n)),
d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
fd AS MATERIALIZED (SELECT id, f, count(*) AS n FROM {_FEATURES.format('d')} GROUP BY ALL),
fb AS MATERIALIZED (SELECT f, count(*) AS n FROM {_FEATURES.format('b')} GROUP BY ALL),
u AS (SELECT DISTINCT f FROM (SELECT f FROM fd UNION ALL SELECT f FROM fb)),
x AS (SELECT f, hex(encode(f)) AS h FROM u),
k AS MATERIALIZED (SELECT f, CAST(xor(4294967295, list_reduce(range(1, len(h), 2), lambda c, i: xor(c // 256, t[xor(c % 256, (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1) + 1]), 4294967295)) % {BUCKETS} AS INT) AS bucket FROM x, tab),
s AS (SELECT bucket, sum(n) AS s FROM fd JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM fb JOIN k USING (f) GROUP BY bucket),
al AS (SELECT CAST(coalesce((SELECT sum(s) FROM s), 0) AS DOUBLE) AS all_s, CAST(coalesce((SELECT sum(t) FROM t), 0) AS DOUBLE) AS all_t),
g AS (SELECT r.bucket, CAST(floor(1000.0::DOUBLE * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS})) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS})))) AS BIGINT) AS gain
  FROM range({BUCKETS}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), al),
ws AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM fd JOIN k USING (f) JOIN g USING (bucket) GROUP BY id),
p AS (SELECT d.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || d.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / {_TWO32}::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN ws USING (id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM p WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * (SELECT count(*) FROM o) // 100 THEN k END AS rank FROM p LEFT JOIN o USING (doc_id)
"""
