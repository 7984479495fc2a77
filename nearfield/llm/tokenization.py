"""Tokenizing whole texts with the tokenizers library, word by word.

A byte-level BPE first splits a text where white space begins, and never
merges over such a place. So a text can be cut at spaces, each distinct word
encoded once by the library and its ids reused. Cuts at which that isn't exact
(inside runs of white space) send the whole text to the library.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from nearfield.llm.common import held

#: Signs that may follow a word; after letters they start a token of their own.
_TAIL = ".,*$%&#!?:;"
_JOINED = 64
_EMPTY, _SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


class TextEncoder:
    """Encodes batches of texts; keeps the ids of words it has met.

    ``most_words`` bounds that memory: when it is full, it starts again empty.
    """

    def __init__(self, path: str, most_words: int = 600_000, slice_bytes: int = 6 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most_words, self.slice_bytes = most_words, slice_bytes
        self._forget()

    def _forget(self) -> None:
        """The ids of all words lie in one array; ``known`` has a word's number, ``ends`` where its ids end."""
        self.known: dict[str, int] = {"": 0}
        self.ids, self.ends = np.empty(1 << 20, "<u4"), np.zeros(1 << 18, np.int64)

    def _keep(self, words: list[str], ids: list[np.ndarray], lengths: list[np.ndarray]) -> None:
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        if first + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(first + len(words), np.int64)])
        self.ends[first : first + len(words)] = self.ends[first - 1] + np.cumsum(np.concatenate(lengths))
        begin, end = int(self.ends[first - 1]), int(self.ends[first + len(words) - 1])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(end, "<u4")])
        self.ids[begin:end] = np.concatenate(ids)

    def whole(self, text: str) -> np.ndarray:
        """The ids of one text, by one call of the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
        ids, lengths = [], []
        for at in range(0, len(plain), _JOINED):
            some = plain[at : at + _JOINED]
            got = self.tokenizer.encode("".join(some), add_special_tokens=False)
            ids.append(np.array(got.ids, dtype="<u4"))
            lengths.append(np.bincount(np.array(got.word_ids), minlength=len(some)))
        if plain:
            self._keep(plain, ids, lengths)
        other = [w for w in words if not (w[0] == " " and w[1:].isalpha())]
        found = [got.ids for got in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        if other:
            self._keep(other, [np.array([x for y in found for x in y], dtype="<u4")], [np.fromiter(map(len, found), np.int64, len(found))])

    @staticmethod
    def _parts(piece: str, lead: str) -> list[str]:
        """Cut a piece without spaces where the library's own split would."""
        if "\n" in piece:
            lines = piece.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                out = TextEncoder._parts(lines[0], lead)
                for line in lines[1:]:
                    out += ["\n", *TextEncoder._parts(line, "")]
                return out
            return [lead + piece]
        core = piece.rstrip(_TAIL)
        if core and len(core) < len(piece) and core.isalpha():
            return [lead + core, piece[len(core) :]]
        return [lead + piece] if lead or piece else []

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """The number of each part among the known words."""
        missing = [x for x in dict.fromkeys(parts) if x not in self.known]
        if len(self.known) + len(missing) > self.most_words:
            self._forget()
            missing = [x for x in dict.fromkeys(parts) if x]
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit numbers; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list[np.ndarray] = []
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + self.slice_bytes, side="right")))
            out += self._slice(texts.slice(start, end - start))
            start = end
        pa.default_memory_pool().release_unused()
        return out

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        pieces = pc.split_pattern(texts, " ")
        offsets = pieces.offsets.to_numpy()
        values = pieces.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        first = offsets[:-1]
        coded = values.dictionary_encode()
        distinct, opening = coded.dictionary, values.take(pa.array(first)).to_pylist()
        n = len(distinct)
        index = coded.indices.to_numpy().astype(np.int64)

        # A cut isn't exact with white space, or nothing, on both sides of its space.
        size = pc.binary_length(distinct).to_numpy(zero_copy_only=False)
        begins = ((pc.binary_length(pc.utf8_ltrim_whitespace(distinct)).to_numpy(zero_copy_only=False) < size) | (size == 0))[index]
        ends = ((pc.binary_length(pc.utf8_rtrim_whitespace(distinct)).to_numpy(zero_copy_only=False) < size) | (size == 0))[index]
        ends[first] = [bool(p) and p[-1].isspace() for p in opening]
        begins[first] = False
        cut = np.flatnonzero(ends[:-1] & begins[1:]) + 1
        unsafe = np.unique(np.searchsorted(offsets, cut, side="right") - 1)

        # Most pieces are letters and then perhaps signs: one or two parts.
        core = pc.utf8_rtrim(distinct, characters=_TAIL)
        plain = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)
        cores = core.dictionary_encode()
        parts = pc.binary_join_element_wise(_EMPTY, cores.dictionary, _SPACE).to_pylist()
        of_core = cores.indices.to_numpy()
        tails: dict[str, int] = {}
        second = np.full(n, -1, np.int64)
        tailed = pa.array(np.flatnonzero(plain & (pc.binary_length(core).to_numpy(zero_copy_only=False) < size)))
        both = zip(distinct.take(tailed).to_pylist(), core.take(tailed).to_pylist())
        second[tailed] = [tails.setdefault(p[len(c) :], len(tails)) for p, c in both]
        second[second >= 0] += len(parts)
        parts += tails
        used = np.zeros(len(parts), bool)
        used[of_core[plain]] = True
        used[len(cores.dictionary) :] = True
        counts = np.where(plain, 1 + (second >= 0), 0)
        odd = np.flatnonzero(~plain)
        more: dict[str, int] = {}
        lists = [[more.setdefault(x, len(more)) for x in self._parts(p, " ")] for p in distinct.take(pa.array(odd)).to_pylist()]
        lists += [[more.setdefault(x, len(more)) for x in self._parts(p, "")] for p in opening]
        counts[odd] = list(map(len, lists[: len(odd)]))
        counts = np.concatenate([counts, list(map(len, lists[len(odd) :]))]).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(bounds[-1], np.int64)
        flat[bounds[:n][plain]] = of_core[plain]
        two = np.flatnonzero(second >= 0)
        flat[bounds[two] + 1] = second[two]
        for k, some in zip([*odd.tolist(), *range(n, n + len(opening))], lists):
            flat[bounds[k] : bounds[k + 1]] = np.array(some, np.int64) + len(parts)
        parts = [x if u else "" for x, u in zip(parts, used.tolist())] + list(more)

        index[first] = n + np.arange(len(texts))
        of_piece = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(flat))
        steps = of_piece.take(pa.array(index)).flatten().to_numpy()
        piece_cuts = np.concatenate([[0], np.cumsum(counts[index])])[offsets]
        steps = self._numbers(parts)[steps]
        begins_at = np.concatenate([[0], self.ends[: len(self.known)]])
        cuts = np.concatenate([[0], np.cumsum(np.diff(begins_at)[steps])])[piece_cuts]
        known = pa.LargeListArray.from_arrays(pa.array(begins_at), pa.array(self.ids[: begins_at[-1]]))
        all_ids = known.take(pa.array(steps)).flatten().to_numpy()
        found = [all_ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for at in unsafe.tolist():
            found[at] = self.whole(texts[at].as_py())
        return found


def encoder_of(path: str) -> TextEncoder:
    """This worker's encoder; the tasks that it runs one after the other share the words it has met."""
    return held(f"encoder {path}", lambda: TextEncoder(path))


def default_vocabulary() -> str:
    """Path of the installed public 50k byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
