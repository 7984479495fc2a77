"""Fill-in-middle transformation by a byte automaton.

One table has, for each state and byte, the next state and what the transition
stands for: that a code point begins, that a unit (a line) ends, that a
sentinel is complete. A first scan runs it over the bytes of many texts and
counts those transitions per document. A second pass goes to the units where a
document is cut, and counts code points between the cuts.

The state after a byte depends on no more bytes than the longest sentinel has.
So the scan runs in lanes, side by side, each warmed up on the bytes before it;
a byte that UTF-8 never has stands between documents and puts a lane back to
the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import own, table
from nearfield.llm.text_bytes import slices

#: What a transition stands for.
CODE_POINT, UNIT_END, SENTINEL = 1, 2, 4
#: Stands between documents: no byte of UTF-8.
BETWEEN = 0xFF
#: Bytes of texts that a task holds at a time; a longer text is held alone.
SLICE_BYTES = 4 << 20
#: Bytes that one step of the scan covers, and the bytes of each lane.
BLOCK, LANE = 1 << 20, 256


@dataclass(frozen=True)
class Automaton:
    """The table for sentinels and a unit's last byte; sentinel s gives SENTINEL << s."""

    sentinels: tuple[bytes, ...]
    unit_end: int = 0x0A

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Next state and meaning by 256 * state + byte. A state is the longest beginning of a sentinel that was just read."""
        starts = sorted({s[:n] for s in self.sentinels for n in range(len(s) + 1)}, key=lambda p: (len(p), p))
        number = {p: k for k, p in enumerate(starts)}
        state, meaning = np.zeros((len(starts), 256), np.uint16), np.zeros((len(starts), 256), np.uint8)
        for p, k in number.items():
            for byte in range(256):
                read = p + bytes([byte])
                if byte != BETWEEN:
                    state[k, byte] = next(number[read[n:]] for n in range(len(read) + 1) if read[n:] in number)
                    meaning[k, byte] = (byte & 0xC0 != 0x80) * CODE_POINT | (byte == self.unit_end) * UNIT_END
                for s, sentinel in enumerate(self.sentinels):
                    if byte != BETWEEN and read.endswith(sentinel):
                        meaning[k, byte] |= SENTINEL << s
        return state.ravel(), meaning.ravel()

    def scan(self, data: np.ndarray) -> np.ndarray:
        """The meaning of every byte's transition, from the start state."""
        state_of, meaning_of = self.table
        warm = max(map(len, self.sentinels))
        out = np.empty(len(data), np.uint8)
        for a in range(0, len(data), BLOCK):
            part = data[a : a + BLOCK]
            lanes = -(-len(part) // LANE)
            padded = np.full(warm + lanes * LANE, BETWEEN, np.uint8)
            padded[warm - min(warm, a) : warm] = data[max(0, a - warm) : a]
            padded[warm : warm + len(part)] = part
            columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, warm + LANE)[::LANE].T)  # row k: byte k of each lane
            state, found = np.zeros(lanes, np.uint16), np.empty((LANE, lanes), np.uint8)
            for k in range(warm + LANE):
                at = (state << 8) | columns[k]
                if k >= warm:
                    found[k - warm] = meaning_of[at]
                state = state_of[at]
            out[a : a + len(part)] = found.T.ravel()[: len(part)]
        return out


def between(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents' bytes with BETWEEN after each, and where each begins."""
    out = np.full(len(data) + len(at) - 1, BETWEEN, np.uint8)
    mask = np.ones(len(out), bool)
    mask[at[1:] + np.arange(len(at) - 1)] = False
    out[mask] = data
    return out, at[:-1] + np.arange(len(at) - 1)


@dataclass(frozen=True)
class FillInMiddle:
    """How documents are cut and put together.

    Of 100 documents ``percent`` are transformed, of 100 of these ``spm_percent``
    have the suffix first. Draws come from a hash of ``seed`` and id.
    """

    seed: int = 7
    percent: int = 100
    spm_percent: int = 50
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    @cached_property
    def automaton(self) -> Automaton:
        if any(BETWEEN in s or not s for s in self.marks):
            raise ValueError("sentinels must be UTF-8 and not empty")
        pairs = [(a, b) for k, a in enumerate(self.marks) for j, b in enumerate(self.marks) if k != j]
        if any(a in b or any(a[:n] == b[-n:] for n in range(1, min(len(a), len(b)))) for a, b in pairs) or any(a[:n] == a[-n:] for a in self.marks for n in range(1, len(a))):
            raise ValueError("no sentinel may overlap with another or itself")
        if sum(map(len, self.marks)) > 255:
            raise ValueError("sentinels are too long for a table of 256 states")
        return Automaton(self.marks)

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix, self.suffix, self.middle

    def draws(self, doc_id: object) -> tuple[int, int, int, int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))

    def transformed(self, doc_id: object, text: np.ndarray, found: np.ndarray) -> tuple[int, str, int | None, int | None, bytes]:
        """Units, form, code points of prefix and middle, and the output, from a text's bytes and their transitions."""
        ends = np.flatnonzero(found & UNIT_END) + 1
        n = len(ends) + bool(len(text) and (not len(ends) or ends[-1] < len(text)))
        h1, h2, h3, h4 = self.draws(doc_id)
        if not n or h3 % 100 >= self.percent or (found >= SENTINEL).any():
            return n, "plain", None, None, text.tobytes()
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        cut = lambda units: 0 if not units else int(ends[units - 1]) if units <= len(ends) else len(text)
        a, b = cut(first), cut(second)
        before, inside, after = text[:a].tobytes(), text[a:b].tobytes(), text[b:].tobytes()
        count = lambda part: int(np.count_nonzero(part & CODE_POINT))
        spm = h4 % 100 < self.spm_percent
        ordered = (self.suffix, after, self.prefix, before) if spm else (self.prefix, before, self.suffix, after)
        return n, "spm" if spm else "psm", count(found[:a]), count(found[a:b]), b"".join((*ordered, self.middle, inside))

    def restored(self, form: str, output: np.ndarray, found: np.ndarray) -> bytes:
        """The text again, from an output's bytes and their transitions."""
        if form == "plain":
            return output.tobytes()
        places = np.flatnonzero(found >= SENTINEL)
        kinds = [int(found[p]) // SENTINEL for p in places]
        if kinds != ([2, 1, 4] if form == "spm" else [1, 2, 4]):
            raise ValueError(f"not an output of form {form}")
        begins = [int(p) + 1 for p in places]
        stops = [begins[k + 1] - len(self.marks[kinds[k + 1].bit_length() - 1]) for k in range(2)] + [len(output)]
        part = {kind: output[a:b].tobytes() for kind, a, b in zip(kinds, begins, stops)}
        return part[1] + part[4] + part[2]


_OUT = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def _texts(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def transform(docs: DataFrame, how: FillInMiddle = FillInMiddle(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row, cut by lines.

    A null text counts as empty and is plain, a null id draws like an empty one,
    repeated rows give equal rows, other columns are left aside whatever their
    names. Nothing is shuffled. A task holds SLICE_BYTES of texts at a time and
    some two bytes more for each of theirs; a longer text is held alone, whole.
    """
    rows = own(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches, "text", SLICE_BYTES):
            joined, begins = between(data, at)
            found = how.automaton.scan(joined)
            ids = batch.column("doc_id").to_pylist()
            made = [how.transformed(i, joined[a : a + n], found[a : a + n]) for i, a, n in zip(ids, begins.tolist(), np.diff(at).tolist())]
            arrays = [pa.array([m[k] for m in made], of) for k, (_, of) in enumerate(_OUT)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, _texts([m[4] for m in made])], names=["doc_id", *(name for name, _ in _OUT), "output"])

    return rows.mapInArrow(each, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, how: FillInMiddle = FillInMiddle()) -> DataFrame:
    """The rows of :func:`transform` and ``text``, rebuilt from form and output by the same automaton."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches, "output", SLICE_BYTES):
            joined, begins = between(data, at)
            found = how.automaton.scan(joined)
            forms = batch.column("form").to_pylist()
            texts = [how.restored(f, joined[a : a + n], found[a : a + n]) for f, a, n in zip(forms, begins.tolist(), np.diff(at).tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts(texts)], names=[*batch.schema.names, "text"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(each, f"{kinds}, text string")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, form and digests of every document, and of what is restored from it."""
    done = restore(transform(table(spark, sf_dir, "documents")))
    digest = lambda c, name: F.sha2(F.col(c).cast("binary"), 256).alias(name)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output", "output_sha256"), digest("text", "restored_sha256"))


_H = "CAST('0x' || substr(s, {0}, 8) AS BIGINT)"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS l, {_H.format(1)} AS h1, {_H.format(9)} AS h2, {_H.format(25)} AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
p AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS p, coalesce(array_to_string(l[a + 1:b], ''), '') AS m, coalesce(array_to_string(l[b + 1:], ''), '') AS q FROM f)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || q || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || q || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
