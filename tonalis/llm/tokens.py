"""Tokenising whole texts with a public vocabulary, one distinct word at a time.

Both vocabularies used here split a text at white space before any merge is
applied, so the ids of a text are the ids of its white-space chunks joined
together.  Natural text repeats its words, so each Python worker remembers the
ids of the chunks that it has met (up to ``MAX_WORDS``) and hands only new ones
to the tokenizers library.  For a byte-level vocabulary, whose ids stand for all
bytes of a text, new chunks are handed over joined to one text, and the ids are
dealt to the chunks by their bytes.  A vocabulary that lower-cases and splits words
at punctuation (``_SPLITS``) gives a word of common letters the ids of its outer
punctuation and of what is between, in small letters, so those parts are what a
worker remembers, and new ones are joined, too; words with other characters stay
whole and are encoded singly.  The byte-level one (``_ENDS``) gives a chunk the ids
of its last punctuation after those of all before it.  The result is identical to the library's plain
``encode(text, add_special_tokens=False)``, which ``tests/llm/test_operators.py``
checks on random texts.  That call reads the vocabulary's control words in a
text, such as ``<|endoftext|>``, as their one id; texts that hold one are encoded
whole.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Remembered chunks; at this number a worker forgets all and starts again.
MAX_WORDS = 500_000
#: New chunks that are joined to one text.
JOINED = 1000
#: Chunks whose ids are put together at once.
GATHERED = 1 << 17
#: Places where a byte-level chunk would not stand alone: a space at either
#: end of the text or beside other white space.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_JOINED_SPACE = rf"^ | $| {_SPACE}|{_SPACE} "
#: Normalizer and pre-tokenizer of a vocabulary that takes words in parts.
_SPLITS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
_END = "</w>"
#: Pre-tokenizer of a byte-level vocabulary that takes marks after a word apart, if it has no normalizer.
_ENDS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORD = " a"
#: What stands at the ends of words: neither letters nor digits nor white space.
MARKS = string.punctuation + "¡«»¿×÷–—‘’‚‛“”„‟…"
#: Letters beside ASCII's that no neighbour composes with and whose small ones take as many bytes: Latin, Greek, Cyrillic.
LETTERS = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x180), *range(0x391, 0x3A2), *range(0x3A3, 0x3CA), *range(0x400, 0x460)]))
_LAST = f"[0-9A-Za-z{LETTERS}]$"


class _Slots(dict):
    """Number of each chunk in order of arrival; ``fresh`` lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        slot = self[chunk] = len(self)
        self.fresh.append(chunk)
        return slot


class WordCache:
    """Encodes texts to ``uint32`` ids.

    ``keeps_space``: the vocabulary is byte-level and gives a word its leading
    space; otherwise white space only separates words and is dropped.
    """

    def __init__(self, path: str, keeps_space: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        words = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What every control word begins with, which is looked for first, and all of them as a pattern.
        self.begins, self.control = os.path.commonprefix(words), "|".join(map(re.escape, words))
        spaced = any(" " in w for w in words)
        #: Whether words are taken in parts, and what a word is told by that stays whole.
        self.parts = not spaced and self._splits()
        self.rare = f"[^0-9A-Za-z{re.escape(MARKS + LETTERS)}]" + (f"|(?i:{self.control})" if words else "")
        #: Bytes that each id of a byte-level vocabulary stands for, one for each character of its name; none where chunks can't be joined, as a control word may span them.
        self.bytes = np.zeros(0, np.int64)
        if self.parts or keeps_space and not spaced:
            names = self.tokenizer.get_vocab(with_added_tokens=True)
            self.bytes = np.zeros(max(names.values()) + 1, np.int64)
            self.bytes[list(names.values())] = [len(w if keeps_space else w.removesuffix(_END)) for w in names]
        self._forget()

    def _splits(self) -> bool:
        t = self.tokenizer
        found = tuple(x and json.loads(x.__getstate__()) for x in (t.normalizer, t.pre_tokenizer))
        end = getattr(t.model, "end_of_word_suffix", None)
        if self.keeps_space:
            return found[0] is None and found[1] is not None and found[1].items() >= _ENDS.items() and not end and len(t.encode(_WORD, add_special_tokens=False).ids) == 1
        return found == _SPLITS and end == _END

    def _forget(self) -> None:
        self.slots = _Slots()
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self) -> None:
        fresh = self.slots.fresh
        if not fresh:
            return
        if self.keeps_space:
            fresh = [w[1:] if w[:1] == " " else " " + w for w in fresh]
        more = np.zeros(len(fresh), np.int64)
        if self.parts and self.keeps_space:  # marks alone are joined, too, after a word of one id
            more[:] = [w[:1] != " " and not w.strip(MARKS) for w in fresh]
            fresh = [_WORD + w if m else w for w, m in zip(fresh, more.tolist(), strict=True)]
        if self.parts and not self.keeps_space:
            plain = np.array(fresh, object).astype(bool) & ~self._rare(pa.array(fresh, pa.string())).to_numpy(zero_copy_only=False)
        else:  # a space, then no white space at either end: what follows in a joined text begins anew at its own space
            plain = np.array([bool(len(self.bytes)) and w[:1] == " " and bool(w[1:2].strip() and w[-1:].strip()) for w in fresh])
        order = np.argsort(~plain, kind="stable")
        n, words = int(plain.sum()), [fresh[i] for i in order.tolist()]
        found = [self._joined(words[i : min(n, i + JOINED)]) for i in range(0, n, JOINED)]
        found += [self._single(words[i : i + 10_000]) for i in range(n, len(words), 10_000)]
        ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        place = np.argsort(order)
        self.starts = np.concatenate([self.starts, (len(self.pool) + np.cumsum(sizes) - sizes)[place] + more])
        self.lengths = np.concatenate([self.lengths, sizes[place] - more])
        self.pool = np.concatenate([self.pool, ids])
        self.slots.fresh.clear()

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        flat, sizes = array("I"), np.empty(len(words), np.int64)
        for n, e in enumerate(self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            ids = e.ids
            flat.extend(ids)
            sizes[n] = len(ids)
        return np.array(flat, np.uint32), sizes

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same from one text, if its ids stand for its bytes."""
        ids = np.array(self.tokenizer.encode_batch_fast([("" if self.keeps_space else " ").join(words)], add_special_tokens=False)[0].ids, np.uint32)
        wanted = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64))
        have = np.cumsum(self.bytes[ids])
        ends = np.searchsorted(have, wanted) + 1
        if not len(have) or have[-1] != wanted[-1] or (have[ends - 1] != wanted).any():
            return self._single(words)
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: Sequence[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        if not len(texts):
            return []
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if len(self.slots) > MAX_WORDS:
            self._forget()
        odd = pc.match_substring_regex(column, _JOINED_SPACE) if self.keeps_space else pa.array(np.zeros(len(column), bool))
        if self.control and (not self.begins or pc.any(pc.match_substring(column, self.begins)).as_py()):
            odd = pc.or_(odd, pc.match_substring_regex(column, self.control))
        whole = {i: column[i].as_py() for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        if whole:
            column = pc.if_else(odd, "", column)
        chunks = pc.split_pattern(column, " ") if self.keeps_space else pc.ascii_split_whitespace(column)
        sizes = chunks.value_lengths().to_numpy().astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        slots, of = self._slots(words)
        if self.keeps_space:  # the first chunk of a text has no space before it
            first = np.cumsum(sizes) - sizes
            heads = self._numbers(words.take(pa.array(codes[first])), " ")
            codes = codes.copy()
            codes[first] = len(words) + np.arange(len(first))
            slots, of = np.concatenate([slots, heads]), np.concatenate([of, of[-1] + 1 + np.arange(len(heads))])
        self._learn()
        pool, ends = self._gather(slots)
        starts = np.concatenate([[0], ends])[of]
        ids, ends = gather(pool, starts[:-1], np.diff(starts), codes)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        out = [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast(list(whole.values()), add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        return out

    def _slots(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The slots of all words' parts, and which of them each word begins at."""
        if not self.parts:
            return self._numbers(words), np.arange(len(words) + 1)
        if not self.keeps_space:
            return self._numbers(self._parted(words)), np.arange(0, 3 * len(words) + 1, 3)
        parts = self._ended(words)
        n = np.arange(0, len(parts), 2)
        both = [self._numbers(parts.take(pa.array(n))), self._numbers(parts.take(pa.array(n + 1)), " ")]
        return np.stack(both, 1).ravel(), np.arange(0, len(parts) + 1, 2)

    def _numbers(self, chunks: pa.Array, before: str = "") -> np.ndarray:
        """The slot of each chunk, with ``before`` put before it."""
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        table = np.fromiter(map(self.slots.__getitem__, [before + w for w in distinct] if before else distinct), np.int64, len(distinct))
        return table[coded.indices.to_numpy()]

    def _rare(self, words: pa.Array) -> pa.Array:
        return pc.match_substring_regex(words, self.rare)

    def _parted(self, words: pa.Array) -> pa.Array:
        """Three parts of each word, any of them may be empty: marks, what is between in small letters, marks."""
        words = words.cast(pa.string())
        whole = self._rare(words)
        words = pc.if_else(whole, words, pc.ascii_lower(words))
        size, first, last = (pc.binary_length(x).to_numpy().astype(np.int32) for x in (words, pc.utf8_ltrim(words, MARKS), pc.utf8_rtrim(words, MARKS)))
        # marks alone are the last part; a lone apostrophe may begin a contraction
        first = np.where(pc.starts_with(words, "'").to_numpy(zero_copy_only=False) & (size - first == 1), 0, np.minimum(size - first, last))
        whole = whole.to_numpy(zero_copy_only=False)
        first[whole], last[whole] = 0, size[whole]
        return _cut(words, size, first, last)

    def _ended(self, words: pa.Array) -> pa.Array:
        """Two parts of each chunk with a space before it: all but the marks that follow its last letter or digit, and those marks."""
        words = words.cast(pa.string())
        stems = pc.utf8_rtrim(words, MARKS)
        size, last = (pc.binary_length(x).to_numpy().astype(np.int32) for x in (words, stems))
        return _cut(words, size, np.where(pc.match_substring_regex(stems, _LAST).to_numpy(zero_copy_only=False), last, size))

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.pool, self.starts, self.lengths, slots)


def _cut(words: pa.Array, size: np.ndarray, *at: np.ndarray) -> pa.Array:
    """Words of ``size`` bytes cut at the places ``at``; the parts lie side by side in the words' own bytes."""
    begin = np.cumsum(size, dtype=np.int32) - size
    edges = np.append(np.stack([begin, *(begin + x for x in at)], 1).ravel(), size.sum(dtype=np.int32))
    start = np.frombuffer(words.buffers()[1], np.int32)[words.offset] if len(words) else 0
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer((edges + start).astype(np.int32)), words.buffers()[2] or pa.py_buffer(b""))


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all slots put together, and where each slot's end."""
    lengths = lengths[slots]
    ends = np.cumsum(lengths)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    for i in range(0, len(slots), GATHERED):
        part, n = slots[i : i + GATHERED], lengths[i : i + GATHERED]
        first = int(ends[i] - n[0])
        last = first + int(n.sum())
        ids[first:last] = pool[np.repeat(starts[part] - ends[i : i + GATHERED] + n, n) + np.arange(first, last)]
    return ids, ends


_caches: dict[tuple[str, bool], WordCache] = {}


def word_cache(path: str, keeps_space: bool) -> WordCache:
    """The worker's own cache, kept for as long as the worker lives."""
    key = (path, keeps_space)
    if key not in _caches:
        _caches[key] = WordCache(*key)
    return _caches[key]


def public_path(name: str) -> str:
    """Where the vocabulary file ``name`` is installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
