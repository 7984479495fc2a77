"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Native: candidates and their features are DataFrame expressions, the forest is
Spark's own. A candidate is a token that looks like a key or stands behind a
word that announces one. The forest sees its length, how likely its character
transitions are, how much of it a dictionary covers, its path, and the words
beside it. Transitions and dictionary come from the words of all documents: the
log probability of each letter after another, and the most frequent words.

Labelled findings are made by rule, ``FINDINGS`` rows of them: random strings
of the shapes that keys have, in places where keys stand, against what such
patterns find by mistake: checksums, commit and object ids, numbers, words
joined by signs, placeholders, paths.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import discard, own, table, unused, written

#: Number of labelled findings that the forest is fitted on; fixed, whatever the input.
FINDINGS = 6000
THRESHOLD = 0.5
#: Words that announce a secret, and words that announce something else.
KEY_WORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "bearer", "key"]
OTHER_WORDS = ["commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "version", "revision", "build", "id", "ref", "example", "sample", "dummy", "test", "placeholder"]
#: Beginnings of keys of public services.
KEY_PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "sk_test_", "AIza", "glpat-", "npm_"]
#: Parts of placeholders.
PLACEHOLDERS = ["example", "sample", "test", "dummy", "your", "change", "insert", "here", "placeholder", "none", "null", "true", "false", "xxxx", "1234", "abcd"]
#: Words of the dictionary at most: the most frequent of all documents, each there LEAST_COUNT times or more.
MOST_WORDS, LEAST_COUNT = 2000, 3
#: A letter counts 1 to 26, anything else 0.
_LETTERS = 27
#: A run of at least 16 characters of keys, with a digit.
TOKEN = r"(?<![A-Za-z0-9+/=_\-])(?=[A-Za-z0-9+/=_\-]*[0-9])[A-Za-z0-9+/=_\-]{16,}(?![A-Za-z0-9+/_\-])"
#: A key word, alone or at the end of a name, with : or =, and an opening quote.
_ANNOUNCED = r"(?<![A-Za-z0-9_.\-])[A-Za-z0-9_.\-]*?(?i:" + "|".join(sorted(KEY_WORDS, key=len, reverse=True)) + r")[\"']?\s{0,3}[:=]\s{0,3}"
#: At least 8 characters without a blank behind it: to the closing quote, or without signs that end a sentence.
KEYED = _ANNOUNCED + r"(?:\"[^\s\"]{8,}|'[^\s']{8,}|[^\s\"'][^\s]{6,}[^\s.,;:)\]}>\"'])"
#: A user and a password of at least 8 characters in a URL. What the patterns begin with can't stand within a match that failed, so
#: each looks at a character a fixed number of times, whatever the text.
_USER = r"://[^\s:/@]*:"
IN_URL = _USER + r"[^\s/@]{8,}(?=@)"


def _found(text: Column, pattern: str, named: str) -> Column:
    """Matches of a pattern as an array of (start, value, before, after); ``named`` is no part of a value."""
    # What lies between the matches gives their places and neighbours.
    values, gaps = F.regexp_extract_all(text, F.lit(rf"(?s)({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    ends = F.aggregate(
        F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.length(v) + F.length(g)),
        F.array(F.lit(0)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )

    def one(kept: Column, v: Column, n: Column) -> Column:
        name = F.regexp_extract(v, named, 1)
        before, after = F.get(kept["gaps"], n), F.get(kept["gaps"], n + 1)
        return F.struct(
            (F.get(kept["ends"], n) + F.length(before) + F.length(name)).cast("long").alias("start"),
            F.substring(v, F.length(name) + 1, F.length(v)).alias("value"),
            F.concat(F.right(before, F.lit(64)), name).alias("before"),
            F.substring(after, 1, 32).alias("after"),
        )

    kept = F.array(F.struct(values.alias("values"), gaps.alias("gaps"), ends.alias("ends")))
    return F.flatten(F.transform(kept, lambda k: F.transform(k["values"], lambda v, n: one(k, v, n))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, path, start, value, before, after.

    ``start`` counts characters of the text from 0. A null text has none. A
    value behind a key word is a candidate as a whole, and so is each token in
    it that looks like a key, and a password in a URL; what is several of these
    is there once.
    """
    names = {"doc_id": id_col, "text": text_col} | ({"path": path_col} if path_col else {})
    rows = own(docs, **names)
    if not path_col:
        rows = rows.withColumn("path", F.lit(""))
    rows = rows.where(F.col("text").rlike(TOKEN) | F.col("text").rlike(KEYED) | F.col("text").rlike(IN_URL))
    tokens = F.filter(_found(F.col("text"), TOKEN, r"^([A-Za-z_\-]{2,}[=:])(.+)$"), lambda x: F.length(x["value"]) >= 8)
    rows = rows.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), tokens.alias("tokens"), _found(F.col("text"), KEYED, rf"(?s)^({_ANNOUNCED}[\"']?)").alias("keyed"), _found(F.col("text"), IN_URL, f"^({_USER})").alias("in_url"))
    new = lambda these, those: F.filter(these, lambda k: ~F.exists(those, lambda t: (t["start"] == k["start"]) & (t["value"] == k["value"])))
    rows = rows.withColumn("tokens", F.concat("tokens", new("keyed", "tokens")))
    return rows.select("doc_id", "path", F.explode(F.concat("tokens", new("in_url", "tokens"))).alias("x")).select("doc_id", "path", "x.start", "x.value", "x.before", "x.after")


@dataclass(frozen=True)
class Corpus:
    """What is learned from all texts: the dictionary, and the log probability of each letter after each (27 x 27)."""

    words: tuple[str, ...]
    transitions: tuple[float, ...]


def _codes(word: Column) -> Column:
    """1 to 26 for the letters of a word in small letters, 0 for other characters and for both ends."""
    inner = F.transform(F.split(word, ""), lambda c: F.when((c >= "a") & (c <= "z"), F.ascii(c) - 96).otherwise(0))
    return F.concat(F.array(F.lit(0)), inner, F.array(F.lit(0)))


def _pairs(codes: Column) -> Column:
    """Number of each transition."""
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * _LETTERS + b)


def learn_corpus(docs: DataFrame, text_col: str = "text") -> Corpus:
    """Dictionary and transitions, counted over the words (runs of two or more of a-z, either case) of all texts.

    Words are counted where they are read before they are shuffled. The driver
    gets MOST_WORDS words and at most 729 counts. Without any words all
    transitions are equally likely.
    """
    words = own(docs, text=text_col).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word").between(2, 40))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT), "words")
    known = counts.where(F.length("word") >= 3).orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()
    pairs = counts.select("n", F.explode(_pairs(_codes(F.col("word")))).alias("at")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    discard(counts)
    seen = np.ones((_LETTERS, _LETTERS))
    for row in pairs:
        seen.flat[row["at"]] += row["n"]
    return Corpus(tuple(r["word"] for r in known), tuple(np.log(seen / seen.sum(axis=1, keepdims=True)).ravel().tolist()))


def _share(pattern: str, of: Column) -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.greatest(F.length(of), F.lit(1))


def features(found: DataFrame, corpus: Corpus) -> tuple[DataFrame, list[str]]:
    """The forest's inputs beside the candidates."""
    logs = F.split(F.lit(" ".join(f"{x:.6f}" for x in corpus.transitions)), " ").cast("array<double>")
    # Runs of letters, also those that a capital begins within a name.
    parts = F.transform(F.regexp_extract_all("value", F.lit("([A-Z]?[a-z]{2,}|[A-Z]{3,})"), F.lit(1)), F.lower)
    covered = F.aggregate(F.filter("x_parts", lambda p: p.isin(list(corpus.words))), F.lit(0), lambda a, p: a + F.length(p)) if corpus.words else F.lit(0)
    found = found.withColumns({"x_parts": F.filter(parts, lambda p: F.length(p) >= 3), "x_logs": F.transform(_pairs(_codes(F.lower("value"))), lambda at: F.get(logs, at))})
    value, before, after, path = (F.col(c) for c in ("value", "before", "after", "path"))
    lower = F.lower(value)
    near = F.lower(F.regexp_extract(before, r"(?s)([\w\-]+)\W*$", 1))
    wider = F.lower(before)
    either = lambda words: "(?i)(?:" + "|".join(words) + ")"
    kinds = {
        "length": F.length(value),
        "is_hex": value.rlike(r"^[0-9a-fA-F]+$"),
        "hex_of_digest": F.length(value).isin(32, 40, 64, 128) & value.rlike(r"^[0-9a-f]+$"),
        "is_uuid": lower.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "is_number": value.rlike(r"^[0-9+\-./=]+$"),
        "digits": _share("[0-9]", value),
        "capitals": _share("[A-Z]", value),
        "signs": _share(r"[+/=_\-]", value),
        # letter to digit and digit to letter, small to capital and back
        "changes": F.regexp_count(value, F.lit(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / F.length(value),
        "transition": F.aggregate("x_logs", F.lit(0.0), lambda a, x: a + x) / F.size("x_logs"),
        "unlikely": F.size(F.filter("x_logs", lambda x: x < -5)) / F.size("x_logs"),
        "runs": _share(r"(.)\1\1", value),
        "different": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "covered": covered / F.length(value),
        "placeholder": 1 - F.length(F.regexp_replace(lower, "|".join(PLACEHOLDERS), "")) / F.length(value),
        "prefix": value.rlike("^(?:" + "|".join(KEY_PREFIXES) + ")"),
        "key_word_beside": near.rlike("(?:^|[_-])(?:" + "|".join(KEY_WORDS) + ")$"),
        "key_word_near": wider.rlike(either(KEY_WORDS)),
        "other_word_beside": near.rlike("^(?:" + "|".join(OTHER_WORDS) + ")$"),
        "other_word_near": wider.rlike(r"\b" + either(OTHER_WORDS) + r"\b"),
        "assigned": before.rlike(r"(?:=|:)\s*[\"']?$"),
        "quoted": before.rlike(r"[\"']$") & after.rlike(r"^[\"']"),
        "in_path": before.rlike(r"[/\\]$|https?:\S*$") | value.contains("//") | after.rlike(r"^[/\\.]\w"),
        "test_path": path.rlike(r"(?i)(?:^|[/_.\-])(?:tests?|examples?|docs?|fixtures?|samples?|lock|min)(?:[/_.\-]|$)"),
        "code_path": path.rlike(r"(?i)\.(?:py|js|java|go|rb|env|ya?ml|json|conf|ini|properties|sh)$"),
    }
    names = list(kinds)
    kept = [c for c in found.columns if c not in ("x_parts", "x_logs")]
    return found.select(*kept, *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"x_{n}") for n, c in kinds.items())), [f"x_{n}" for n in names]


def _random_text(alphabet: str, length: Column, salt: str) -> Column:
    """Characters of ``alphabet`` chosen by hashes of the row's number and ``salt``."""
    at = lambda k: F.pmod(F.xxhash64("id", F.lit(salt), k), F.lit(len(alphabet))).cast("int") + 1
    return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda k: F.substring(F.lit(alphabet), at(k), F.lit(1))), "")


def _one_of(words: list[str], salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))).cast("int") + 1)


def labelled_findings(spark: SparkSession, rows: int = FINDINGS, words: tuple[str, ...] = ()) -> DataFrame:
    """Findings of known kind: value, before, after, path, label (1 secret); the same on every call.

    ``words`` (of the dictionary) make up prose, names and paths in them.
    """
    hexa, digits = "0123456789abcdef", "0123456789"
    full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    base64 = full + "+/"
    pick = lambda low, high, salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")
    words = list(words[:300]) or "the config of user data table entry node line value index report service north water stone river".split()
    word = lambda salt: _one_of(words, salt)
    prose = F.concat_ws(" ", word("w1"), word("w2"), word("w3"), F.lit(""))
    key_before = F.concat(prose, _one_of(KEY_WORDS, "k"), _one_of(["=", " = ", ": ", "=\"", " = \"", ": '", ":"], "s"))
    other_before = F.concat(prose, _one_of(OTHER_WORDS, "o"), _one_of(["=", " = ", ": ", " ", " \"", ":"], "s"))
    after = _one_of(["\"", " ", "'", "\n", ", ", " and ", "\" and "], "a")
    code = _one_of(["src/app.py", "conf/app.yaml", ".env", "web/main.js", "src0", "src7", "crawl", ""], "p")
    doc_path = _one_of(["tests/data.py", "docs/guide.md", "package.lock", "examples/run.sh", "src0", "src7", "crawl", ""], "p")
    joined = lambda sign: F.concat_ws(sign, word("v1"), word("v2"), word("v3"), _random_text(digits, pick(1, 4, "n"), "v4"))
    kinds: list[tuple[Column, Column, Column, int]] = [
        (_random_text(hexa, F.element_at(F.array(*map(F.lit, (16, 18, 20, 24, 32, 40, 48, 64))), pick(1, 8, "n")), "v"), key_before, code, 1),
        (_random_text(full, pick(16, 64, "n"), "v"), key_before, code, 1),
        (_random_text(base64, pick(24, 88, "n"), "v"), key_before, code, 1),
        (F.concat(_one_of(KEY_PREFIXES, "x"), _random_text("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", F.lit(16), "v")), prose, code, 1),
        (F.concat(_one_of(KEY_PREFIXES, "x"), _random_text(full, pick(16, 40, "n"), "v")), F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, key_before).otherwise(prose), code, 1),
        (_random_text(hexa, F.element_at(F.array(*map(F.lit, (32, 40, 64))), pick(1, 3, "n")), "v"), other_before, doc_path, 0),
        (_random_text(hexa, F.element_at(F.array(*map(F.lit, (32, 40, 64))), pick(1, 3, "n")), "v"), prose, doc_path, 0),
        (F.concat_ws("-", *(_random_text(hexa, F.lit(n), f"u{k}") for k, n in enumerate((8, 4, 4, 4, 12)))), F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, other_before).otherwise(prose), code, 0),
        (_random_text(digits, pick(16, 20, "n"), "v"), F.when(F.pmod(F.xxhash64("id"), F.lit(4)) == 0, other_before).otherwise(prose), code, 0),
        (joined("_"), F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, key_before).otherwise(prose), code, 0),
        (joined("-"), prose, doc_path, 0),
        (joined("/"), F.concat(prose, _one_of(["/", "https://", "./", "path ", "file:"], "s")), doc_path, 0),
        (F.concat(_one_of(["your_", "YOUR-", "example_", "test", "insert-", "dummy_"], "y"), _one_of(["token_here_", "password-", "api_key_", "secretvalue"], "z"), _random_text("01234x", pick(1, 8, "n"), "v")), key_before, doc_path, 0),
        (F.concat(F.repeat(_one_of(["x", "0", "a1", "123", "abc1"], "y"), pick(8, 20, "n")), F.lit("1")), key_before, code, 0),
    ]
    # Passwords: short, with signs, without digits; very long keys; and words that stand where passwords do.
    word_of = "password passwd pwd secret db_password credential".split()
    asked = F.concat(prose, _one_of(word_of, "k"), _one_of(["=", " = ", ": ", "=\"", " = \"", ": '", ":"], "s"))
    kinds += [
        (F.concat(word("v1"), _random_text(digits + "xqz!@&#$%", pick(4, 7, "n"), "v")), asked, code, 1),
        (_random_text(full + "!@&#$%", pick(8, 20, "n"), "v"), asked, code, 1),
        (_random_text(full[:52], pick(10, 40, "n"), "v"), key_before, code, 1),
        (_random_text(base64, pick(257, 600, "n"), "v"), F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, key_before).otherwise(prose), code, 1),
        (_random_text(full + "!&#$%", pick(8, 20, "n"), "v"), F.concat(prose, _one_of("postgres mysql https amqp redis ftp mongodb".split(), "k"), F.lit("://"), word("v5"), F.lit(":")), code, 1),
        (F.concat(_one_of("required optional undefined function document something".split(), "v1"), _one_of(["", "", "ing", "s", ",", "()"], "v2")), key_before, code, 0),
        (F.concat(word("v1"), _one_of(["", "-", "_", ".", "/"], "v2"), word("v3"), F.lit("s")), key_before, code, 0),
    ]
    each = -(-rows // len(kinds))
    made = [
        spark.range(k * each, (k + 1) * each, numPartitions=1).select(v.alias("value"), b.alias("before"), after.alias("after"), p.alias("path"), F.lit(y).cast("double").alias("label"))
        for k, (v, b, p, y) in enumerate(kinds)
    ]
    return reduce(DataFrame.unionByName, made)


def train_forest(findings: DataFrame, corpus: Corpus, trees: int = 40, depth: int = 10, seed: int = 5) -> tuple[RandomForestClassificationModel, list[str]]:
    """The forest, fitted on labelled findings."""
    rows, names = features(findings, corpus)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label").coalesce(1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows), names


def scan(
    docs: DataFrame,
    findings: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    threshold: float = THRESHOLD,
    corpus: Corpus | None = None,
) -> DataFrame:
    """Every candidate with the forest's probability; one row per candidate.

    Columns: doc_id, path, start, value, before, after, probability, is_secret.
    ``findings`` are labelled findings to train on, the made ones by default;
    ``corpus`` is what ``learn_corpus`` gives, by default that of ``docs``.
    Null and empty texts have no candidates; null ids, null paths (as empty
    ones) and repeated rows stay; an empty table gives no rows. Rows are
    scanned where they are read; only counts of words are shuffled. Very long
    texts are scanned whole, one at a time.
    """
    corpus = corpus or learn_corpus(docs, text_col)
    forest, names = train_forest(findings if findings is not None else labelled_findings(docs.sparkSession, words=corpus.words), corpus)
    rows, _ = features(candidates(docs, id_col, text_col, path_col), corpus)
    scored = forest.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    probability = vector_to_array("probability")[1]
    return scored.select("doc_id", "path", "start", "value", "before", "after", probability.alias("probability")).withColumn("is_secret", F.col("probability") >= threshold)


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every value that ``scan`` holds for a secret replaced by ``mark``."""
    key, values = unused(docs, "key"), unused(docs, "values")
    secret = found.where("is_secret").groupBy(F.col("doc_id").alias(key)).agg(F.array_distinct(F.collect_list("value")).alias(values))
    # A value may be a part of another one: the longer first.
    secret = secret.withColumn(values, F.array_sort(values, lambda a, b: F.length(b) - F.length(a)))
    joined = docs.join(secret, docs[f"`{id_col}`"].eqNullSafe(secret[key]), "left")
    clean = F.aggregate(F.coalesce(values, F.array().cast("array<string>")), F.col(f"`{text_col}`"), lambda t, v: F.replace(t, v, F.lit(mark)))
    return joined.withColumn(text_col, clean).select(*(f"`{c}`" for c in docs.columns))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document: place, digest of the value, probability and verdict."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret")
