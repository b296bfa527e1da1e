"""Words and token ids of Arrow text columns, in vectors."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: End-of-document id appended to each document.
END_ID = 1
#: Stems in each of the two generations of the cache, about 200 bytes each.
CACHE_WORDS = 350_000
#: Digits and letters that are one letter still in lower case and canonical composition, as U+0130 is not.
STEM_END = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3C9}\x{400}-\x{481}\x{48A}-\x{52F}]$"
#: Words of letters that are encoded as one text.
JOINED = 64
#: Text bytes handled at once inside a task.
SLICE_BYTES = 6 << 20

_ENCODERS: dict[str, WordEncoder] = {}


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(first word of each text and the end, all words): runs of bytes other than space and U+0009 to U+000D; null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept_before = np.concatenate(([0], np.cumsum(full)))
    return kept_before[offsets], flat.filter(pa.array(full))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(starts) or int(starts.max()) < 1 << 30) else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - (ends - lengths)).astype(kind), lengths)


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` text bytes, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _piece_ends(path: str) -> np.ndarray | None:
    """By id, whether a token ends a piece; None where the vocabulary does not tell for every byte that can end one."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    if not suffix or "ByteLevel" not in str(spec.get("pre_tokenizer")) or sum(len(t) == len(suffix) + 1 and t.endswith(suffix) for t in model["vocab"]) < 256:
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
    return ends


class WordEncoder:
    """Encodes texts with a tokenizers file by encoding each distinct white-space word once.

    Equal to encoding the text at once for tokenizers that drop white space before they merge: no
    piece spans a gap, and normalisation of a word does not look across one. ``tests/llm`` holds
    that against whole-text encoding.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = _piece_ends(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
        """The process's encoder of that file."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        _ENCODERS[path].cache_words = cache_words
        return _ENCODERS[path]

    def _ids(self, stems: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        missing = []
        for word in stems:
            if word not in young:
                if word in old:
                    young[word] = old[word]
                else:
                    missing.append(word)
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            plain = pc.match_substring_regex(pa.array(part, pa.string()), r"^\p{L}+$").to_numpy(zero_copy_only=False)
            letters, others = [w for w, p in zip(part, plain) if p], [w for w, p in zip(part, plain) if not p]
            for words, found, size in (self._joined(letters), self._apart(others)):
                ends = (4 * np.cumsum(size)).tolist()
                raw = found.astype("<u4").tobytes()
                young.update((w, raw[a:b]) for w, a, b in zip(words, [0, *ends], ends))
        out = [young[w] for w in stems]
        if len(young) > self.cache_words:
            self.old, self.young = young, {}
        return out

    def _apart(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(words, all ids, number of ids of each), each word a text of its own."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return words, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _joined(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The same of words of letters, ``JOINED`` to a text: half the cost. Where a text has as many pieces as words,
        each word is one piece; words of a text that has more are encoded apart."""
        if self.ends is None:
            return self._apart(words)
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        kept, again, ids, sizes = [], [], [], []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            found = np.array(e.ids, np.uint32)
            last = np.flatnonzero(self.ends[found])
            if len(last) == len(group):
                kept += group
                ids.append(found)
                sizes.append(np.diff(last, prepend=-1))
            else:
                again += group
        _, more, size = self._apart(again)
        return kept + again, np.concatenate([*ids, more]), np.concatenate([*sizes, size])

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of distinct words. A word is looked up as its stem before final full stops and commas
        where the stem ends as ``STEM_END`` says, since the tokenizer parts them there anyway; ASCII stems share one case."""
        stem = pc.utf8_rtrim(words, ".,")
        parts = pc.match_substring_regex(stem, STEM_END)
        stem = pc.if_else(parts, stem, words)
        stem = pc.if_else(pc.match_substring_regex(stem, "^[A-Za-z0-9]+$"), pc.ascii_lower(stem), stem)
        cut = pc.subtract(pc.binary_length(words), pc.binary_length(stem)).to_numpy(zero_copy_only=False)
        tail, tails_seen = np.zeros(len(words), np.int64), [""]
        for n in np.unique(cut[cut > 0]):
            where = np.flatnonzero(cut == n)
            coded = pc.utf8_slice_codeunits(words.take(pa.array(where)), start=-int(n)).dictionary_encode()
            tail[where] = coded.indices.to_numpy() + len(tails_seen)
            tails_seen += coded.dictionary.to_pylist()
        coded = stem.dictionary_encode()
        out = []
        for distinct, which in ((coded.dictionary.to_pylist(), coded.indices.to_numpy()), (tails_seen, tail)):
            found = self._ids(distinct)
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            out.append((size[which], (np.cumsum(size) - size)[which], np.frombuffer(b"".join(found), "<u4")))
        (n_stem, at_stem, stems), (n_tail, at_tail, tails) = out
        both = n_stem + n_tail
        first = np.cumsum(both) - both
        table = np.empty(int(both.sum()), np.uint32)
        table[ragged(first, n_stem)] = stems[ragged(at_stem, n_stem)]
        table[ragged(first + n_stem, n_tail)] = tails[ragged(at_tail, n_tail)]
        return both, table

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(first id of each text and the end, all ids as uint32), with end_id after each text; null texts are empty."""
        first, flat = split_words(texts)
        coded = flat.dictionary_encode()
        lengths, table = self._table(coded.dictionary)
        starts = np.cumsum(lengths) - lengths
        which = coded.indices.to_numpy()
        took = lengths[which]
        before = np.concatenate(([0], np.cumsum(took)))
        bounds = before[first]
        n_docs = len(bounds) - 1
        if end_id is None:
            return bounds, table[ragged(starts[which], took)]
        ends = bounds[1:] + np.arange(1, n_docs + 1)
        out = np.full(int(bounds[-1]) + n_docs, end_id, np.uint32)
        shift = np.repeat(np.arange(n_docs), np.diff(first))
        out[ragged(before[:-1] + shift, took)] = table[ragged(starts[which], took)]
        return np.concatenate(([0], ends)), out
