"""Line-first cleaning of documents.

Every line is judged by itself: shouting, symbols, navigation separators,
stuttering, boilerplate sentences, a missing sentence end, an earlier equal
line. Lines that fail are removed; a document that thereby loses too large a
part of its words, or that fails the base rules, is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nearfield.llm.common import held, own, table

SYMBOLS = b"#*$%&|<>"
SENTENCE_END = (b".", b"!", b"?", b"\"", b"'", b")", b":", b";", "…".encode(), "”".encode(), "»".encode(), "。".encode())
SEPARATORS = {b"|", b">", b"<", b"\xc2\xbb", b"\xc2\xab", b"\xe2\x80\xa2", b"/"}
#: Fixed phrases of lines that belong to a page and not to its text, in lower case.
BOILERPLATE = (
    b"all rights reserved", b"cookie", b"privacy policy", b"terms of use", b"terms of service", b"enable javascript",
    b"lorem ipsum", b"subscribe to our", b"sign up for", b"click here", b"licensed under", b"license, version",
)
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_WHITE_ONLY = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the two document rules."""

    symbols_per_word: float = 0.3
    separators_per_word: float = 0.2
    shouted: float = 0.5
    stuttered: float = 0.5
    most_lost: float = 0.4
    min_words: int = 50
    max_repeat_percent: int = 50


def _code_points(b: bytes) -> int:
    return len(b.translate(None, _CONTINUATION))


def _shouts(line: bytes, words: list[bytes], share: float) -> bool:
    """Whether more than ``share`` of the words with two letters are in capitals."""
    if len(words) < 3 or line.isascii() and 8 * (len(line) - len(line.translate(None, _UPPER))) < share * len(line):
        return False  # too few capitals to decide by word
    text = line.decode("utf-8", "replace").split()
    if not any(map(str.isupper, text)):
        return False
    letters = [w for w in text if sum(map(str.isalpha, w)) > 1]
    return sum(map(str.isupper, letters)) > share * max(1, len(letters))


def line_fault(line: bytes, words: list[bytes], rules: LineRules, phrases: tuple[bytes, ...] = BOILERPLATE) -> str | None:
    """The name of the first rule that a line with at least one word breaks."""
    n = len(words)
    if len(line) - len(line.translate(None, SYMBOLS)) > rules.symbols_per_word * n:
        return "symbols"
    if sum(map(SEPARATORS.__contains__, words)) > rules.separators_per_word * n:
        return "navigation"
    if _shouts(line, words, rules.shouted):
        return "shouting"
    if n >= 4 and sum(map(bytes.__eq__, words, words[1:])) > rules.stuttered * n:
        return "stutter"
    if phrases and any(map(line.lower().__contains__, phrases)):
        return "boilerplate"
    if not words[-1].endswith(SENTENCE_END):
        return "punctuation"
    return None


def _repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found, covered, reach = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if found[window] > 1:
            covered += at + 3 - max(at, reach)
            reach = at + 3
    return covered


def judge(text: str | None, rules: LineRules = LineRules()) -> dict:
    """Counts, verdict and cleaned text of one document; a null text is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    dup_lines = lost = 0
    kept_lines, removed = [], []
    lower = raw.lower()
    phrases = tuple(p for p in BOILERPLATE if p in lower)
    for number, line in enumerate(raw.split(b"\n")):
        own_words = line.split()
        if not own_words:
            kept_lines.append(line)
            continue
        fault = line_fault(line, own_words, rules, phrases)
        if line in seen:
            dup_lines += 1
            fault = fault or "duplicate"
        seen.add(line)
        if fault:
            lost += len(own_words)
            removed.append(f"{number}:{fault}")
        else:
            kept_lines.append(line)
    n = len(words)
    repeats = _repeat_words(words)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    return {
        "n_words": n,
        "word_chars": _code_points(raw.translate(None, _WHITE_ONLY)),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "lost_words": lost,
        "kept": not base_failed and lost <= rules.most_lost * n,
        "removed": removed,
        "cleaned": b"\n".join(kept_lines).decode("utf-8", "surrogatepass"),
    }


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_words long, kept boolean, removed array<string>, cleaned string"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept"]


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True
) -> DataFrame:
    """Judge every document; one row per input row.

    Columns: the id, the counts of :func:`judge`, ``kept``, and with
    ``with_text`` the removed lines (``number:rule``) and the cleaned text.
    A null text counts as empty, so it has no words and is rejected; a null id
    stays null; repeated rows give repeated rows. There is no shuffle: memory
    per task is one Arrow batch and the windows of one document.
    """
    rows = own(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = _COUNTS + (["removed", "cleaned"] if with_text else [])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(text, rules) for text in batch.column("text").to_pylist()]
            arrays = [batch.column("doc_id")]
            for name in names:
                at = pa.bool_() if name in ("kept", "base_failed") else pa.list_(pa.string()) if name == "removed" else pa.string() if name == "cleaned" else pa.int64()
                arrays.append(pa.array([x[name] for x in found], at))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names])

    schema = f"doc_id {kind}, " + (_OUT if with_text else _OUT.split(", removed")[0])
    return rows.mapInArrow(each, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def kept_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), cleaned: bool = False
) -> DataFrame:
    """The rows whose text :func:`judge` keeps, with all their columns.

    With ``cleaned`` the text is what the line rules leave of it. Rows are
    judged where they are read: nothing is shuffled or joined.
    """
    names = docs.columns
    place = names.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality", dict)
        for batch in (x.slice(a, 2000) for x in batches for a in range(0, len(x), 2000)):
            found = [judge(text, rules) for text in batch.column(place).to_pylist()]
            keep = pa.array([x["kept"] for x in found], pa.bool_())
            if cleaned:
                batch = batch.set_column(place, batch.schema.field(place), pa.array([x["cleaned"] for x in found], batch.schema.field(place).type))
            yield batch.filter(keep)

    return docs.mapInArrow(each, docs.schema)
