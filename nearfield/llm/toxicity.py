"""Toxicity scores on text that a noisy-channel decoder has restored.

Words that may be disguised, by digits and signs for letters, by letters set
apart, or by letters repeated, become lattices of the characters they may
stand for; the Viterbi algorithm picks the likeliest path under a character
trigram model counted over all documents. Restored words are scored with
weights learned from labels: of whole words, and of how words begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import held, own, table

#: The letters that the character model tells apart; 0 stands for all else.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøùúûüýÿßœ"
#: The letters that digits and signs commonly stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
_SUBSTITUTE, _REPEAT, _DROP, _DROP_LEET = -1.0, -0.5, -1.5, -6.0
_SIZE = len(LETTERS) + 1
_CODE = np.zeros(0x250, np.int64)
for _k, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _CODE[ord(_c.upper()) if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250 else ord(_c)] = _k + 1
_LETTER_CODE = {c: int(_CODE[ord(c)]) for c in map(chr, range(0x250)) if _CODE[ord(c)]}
_RUN = re.compile(r"(.)\1", re.DOTALL)
_EDGE = ".,;:?!\"'()[]{}<>«»„“”…#*%&$|"
#: Edge signs that never are letters, and those with the exclamation mark, which seldom is one at a word's end.
_FRAME = "".join(c for c in _EDGE if c not in LEET)
_END = _FRAME + "!"
_LETTER = "(?:[^\\W_]|[" + re.escape("".join(c for c in LEET if not c.isdigit())) + "])"
#: Letters set apart, all by the same signs or by any.
_SPACED = [re.compile(rf"(?<![^\W_]){_LETTER}([\s._\-*]{{1,3}}){_LETTER}(?:\1{_LETTER})+(?![^\W_])"), re.compile(rf"(?<![^\W_])(?:{_LETTER}[\s._\-*]{{1,3}}){{2,}}{_LETTER}(?![^\W_])")]


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < len(_CODE), _CODE[np.minimum(points, len(_CODE) - 1)], 0)


class CharacterModel:
    """Log probabilities of a character after two others, with add-one smoothing on lower orders."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + _SIZE)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        log = np.log((three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5))
        self.log = log.ravel().tolist()  # read one by one

    def restore(self, word: str) -> str:
        """The likeliest word of letters that ``word`` may stand for."""
        # The best path to each pair of last letters: its score, and what it wrote last behind the path before.
        log, best = self.log, {0: (0.0, None)}
        at = 0
        while at < len(word):
            c = word[at]
            end = at
            while end < len(word) and word[end] == c:
                end += 1
            run = end - at
            at = end
            letters = c if c in _LETTER_CODE else LEET.get(c, "")
            ways = [] if c.isalpha() else [("", (), (_DROP_LEET if c in LEET else _DROP) * run)]
            cost = 0.0 if c.isalpha() else _SUBSTITUTE
            ways += [(x * k, (_LETTER_CODE[x],) * k, cost + _REPEAT * abs(run - k)) for x in letters for k in (1, 2) if k <= run]
            if not ways:
                ways = [(c * run, (0,) * run, 0.0)]
            step: dict[int, tuple[float, tuple | None]] = {}
            for pair, (score, before) in best.items():
                for out, codes, cost in ways:
                    s, p = score + cost, pair
                    for code in codes:
                        s += log[p * _SIZE + code]
                        p = p % _SIZE * _SIZE + code
                    if p not in step or s > step[p][0]:
                        step[p] = (s, (out, before) if out else before)
            best = step
        _, path = max(((score + log[pair * _SIZE], path) for pair, (score, path) in best.items()), key=lambda x: x[0])
        parts = []
        while path:
            parts.append(path[0])
            path = path[1]
        return "".join(reversed(parts))


def decoder(counts: np.ndarray) -> tuple[CharacterModel, dict[str, str]]:
    """The model of these counts and the words it has restored, shared by the tasks of a worker."""
    return held(f"toxicity-{crc32(counts.tobytes())}", lambda: (CharacterModel(counts), {}))


def disguised(word: str) -> bool:
    """Whether a word has digits or signs that may stand for letters, or a letter repeated."""
    if word.isalpha():
        return _RUN.search(word) is not None
    return any(map(LEET.__contains__, word))


def _with_edges(word: str) -> set[str]:
    """A word with those signs at its edges that may be letters."""
    starts = {word.lstrip(_EDGE), word.lstrip(_FRAME)}
    return {x for w in starts for x in (w.rstrip(_EDGE), w.rstrip(_END), w.rstrip(_FRAME))}


def _joined(text: str) -> set[str]:
    """Words whose letters are set apart, joined."""
    return {re.sub(r"[\s._\-*]+", "", m.group(0)) for spaced in _SPACED for m in spaced.finditer(text)}


def restored_words(text: str | None, model: CharacterModel, known: dict[str, str]) -> tuple[set[str], int]:
    """The different words of a text, disguised ones restored, and how many words it has."""
    raw = (text or "").lower()
    words = raw.split()
    odd = set()
    found = set()
    for w in set(words):
        core = w.strip(_EDGE)
        found.add(core)
        if w.isalpha():
            if _RUN.search(w):
                odd.add(w)
            continue
        if core and disguised(core):
            odd.add(core)
        if len(w) > len(core) and not w.strip(_FRAME) == core:
            odd |= _with_edges(w)
        if len(core) > 4 and not core.isalnum():
            odd |= _joined(w)
    if sum(len(w) == 1 or len(w) < 4 and not w.isalpha() for w in words) >= 2:
        odd |= _joined(raw)
    for w in odd:
        if w not in known:
            if len(known) > 200_000:
                known.clear()
            known[w] = model.restore(w) if disguised(w) else w
        found.add(known[w])
    found.discard("")
    return found, len(words)


def features_of(words: set[str]) -> set[str]:
    """Whole words, and their first four and five letters marked by a star."""
    out = set(words)
    for w in words:
        if len(w) > 4:
            out.add(w[:4] + "*")
            if len(w) > 5:
                out.add(w[:5] + "*")
    return out


def count_characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character trigrams of all texts; the driver gets at most one row per trigram."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for a in range(0, len(batch), 500):
                joined = " ".join(x for x in batch.column("text").slice(a, 500).to_pylist() if x)
                codes = np.concatenate([[0, 0], _codes(joined), [0]])
                total += np.bincount((codes[:-2] * _SIZE + codes[1:-1]) * _SIZE + codes[2:], minlength=_SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    counts = own(docs, text=text_col).mapInArrow(each, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_SIZE**3, np.int64)
    out[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
    return out


@dataclass
class ToxicityModel:
    """What scoring needs: the character model's counts, word weights, and the weights of their sums."""

    characters: np.ndarray
    weights: dict[str, float]
    coefficients: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def inputs(self, words: set[str], count: int, weights: dict[str, float] | None = None) -> list[float]:
        get = (self.weights if weights is None else weights).get
        hits = sorted((max(get(w, 0.0), get(w[:4] + "*", 0.0), get(w[:5] + "*", 0.0)) for w in words), reverse=True)
        hits = [h for h in hits if h > 0]
        return [hits[0] if hits else 0.0, np.log1p(sum(hits)), len(hits) / (1 + len(words)), float(bool(hits))]

    def score(self, inputs: np.ndarray) -> np.ndarray:
        z = ((inputs - self.centre) / self.scale) @ self.coefficients[1:] + self.coefficients[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    a = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w = np.zeros(a.shape[1])
    penalty = ridge * len(x) * np.eye(len(w)) * 1e-2
    penalty[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def held_out(doc_id: Column) -> Column:
    """Rows of which no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_rows: int = 20_000,
    most_weights: int = 4096,
    least_share: float = 0.01,
    least_documents: int = 3,
    least_weight: float = 3.0,
) -> ToxicityModel:
    """Learn from at most ``most_rows`` labelled rows, the first by hash, that aren't held out.

    Words' weights are counted on the same rows that the score is fitted on, so
    a row's own share of them is left out there: else words that only it has
    would look like evidence. The character model is counted over all documents. A document with several
    labels counts with the largest. Without labels of both kinds there are no weights and every score is the share of label 1, or 0. A word
    needs ``least_documents`` toxic documents, or ``least_share`` of them, to count.
    """
    spark = docs.sparkSession
    characters = count_characters(docs, text_col)
    known = own(labels, doc_id=id_col, y=label_col).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    sample = own(docs, doc_id=id_col, text=text_col).join(F.broadcast(known), "doc_id").select(F.col("y").cast("int").alias("y"), "text")
    shared = spark.sparkContext.broadcast(characters)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, seen), found = decoder(shared.value), {}
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                for feature in ["", *features_of(restored_words(text, model, seen)[0])]:
                    found.setdefault(feature, [0, 0])[y > 0] += 1
            if len(found) > 500_000:
                yield flush(found)
        if found:
            yield flush(found)

    def flush(found: dict[str, list[int]]) -> pa.RecordBatch:
        counts = np.array(list(found.values()), np.int64)
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["feature", "n0", "n1"])
        found.clear()
        return out

    counts = sample.mapInArrow(counted, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = counts.where("feature = ''").first()
    n0, n1 = (total["n0"], total["n1"]) if total else (0, 0)
    if not n0 or not n1:
        return ToxicityModel(characters, {}, np.array([30.0 if n1 else -30.0, 0, 0, 0, 0]), np.zeros(4), np.ones(4))
    least, fewest = min(least_weight, np.log((n0 + 1) / 2)), max(least_documents, least_share * n1)
    weight = lambda ones, zeros, all1, all0: np.log((ones + 0.5) / (all1 + 1)) - np.log((zeros + 0.5) / (all0 + 1))
    without = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.greatest(F.col("n0") - 1, F.lit(0)) + 0.5) / n0)
    chosen = counts.where((F.col("feature") != "") & (F.col("n1") >= fewest)).withColumn("w", without).where(F.col("w") >= least)
    chosen = [tuple(r) for r in chosen.orderBy(F.desc(F.col("w") * F.col("n1")), "feature").limit(most_weights).select("feature", "n0", "n1").collect()]
    enough = lambda f, ones, w: {f: float(w)} if ones >= fewest and w >= least else {}
    weights, seen0, seen1 = {}, {}, {}
    for f, zeros, ones in chosen:
        weights |= enough(f, ones, weight(ones, zeros, n1, n0))
        # What the feature would weigh without a document of that label that has it.
        seen0 |= enough(f, ones, weight(ones, max(0, zeros - 1), n1, n0 - 1))
        seen1 |= enough(f, ones - 1, weight(ones - 1, zeros, n1 - 1, n0))
    model = ToxicityModel(characters, weights, np.zeros(5), np.zeros(4), np.ones(4))
    rows = _inputs(sample, model, ["y"], (seen0, seen1)).toArrow()  # at most most_rows rows of five numbers
    x = np.column_stack([rows.column(f"x{k}").to_numpy() for k in range(4)])
    order = np.lexsort([*x.T, rows.column("y").to_numpy()])
    model.coefficients, model.centre, model.scale = _fit(x[order], rows.column("y").to_numpy()[order].astype(float))
    return model


def _inputs(docs: DataFrame, model: ToxicityModel, keep: list[str], by_label: tuple[dict[str, float], dict[str, float]] | None = None) -> DataFrame:
    """The columns to ``keep``, four inputs and the score of each row; ``by_label`` are weights for rows whose y is 0 or 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model, by_label))
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, by_label = shared.value
        restorer, seen = decoder(model.characters)
        for batch in batches:
            own_weights = [by_label[int(y > 0)] for y in batch.column("y").to_pylist()] if by_label else [None] * len(batch)
            x = np.array([model.inputs(*restored_words(t, restorer, seen), w) for t, w in zip(batch.column("text").to_pylist(), own_weights)], float).reshape(-1, 4)
            arrays = [batch.column(c) for c in keep] + [pa.array(x[:, k]) for k in range(4)] + [pa.array(model.score(x))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "x0", "x1", "x2", "x3", "score"])

    return docs.select(*keep, "text").mapInArrow(each, f"{kinds}, x0 double, x1 double, x2 double, x3 double, score double")


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; a null text is scored like an empty one, null ids and repeated rows stay."""
    return _inputs(own(docs, doc_id=id_col, text=text_col), model, ["doc_id"]).select("doc_id", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
