"""Words of whole texts as 64-bit numbers, a batch at a time.

A word is what stands between white space, in lower case, without the
punctuation at its ends; what is left empty is no word.  Texts are split, their
distinct words found, lowered and stripped by Arrow; Python hashes those, and
lowers the few with letters beyond ``_NEAR``, where its rules are others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”‘’„…—–¡¿"
#: Characters below U+0130 and the stripped ones; of words that hold no others Arrow's small letters are Python's.
_NEAR = r"\x00-\x{12f}" + "".join(rf"\x{{{ord(c):x}}}" for c in _STRIP if c > "\u012f")


def normal_word(word: str) -> str:
    """The word as it is compared."""
    return word.lower().strip(_STRIP)


def word_number(word: str) -> int:
    """Number of a compared word; 0 for the empty one alone."""
    return (xxhash.xxh3_64_intdigest(word) | 1) if word else 0


def _numbers(words: pa.Array) -> np.ndarray:
    """``word_number`` of the ``normal_word`` of each."""
    normal = pc.utf8_trim(pc.utf8_lower(words), _STRIP).to_numpy(zero_copy_only=False)
    far = np.flatnonzero(pc.match_substring_regex(words, f"[^{_NEAR}]").to_numpy(zero_copy_only=False))
    for i in far.tolist():
        normal[i] = normal_word(words[i].as_py())
    out = np.fromiter(map(xxhash.xxh3_64_intdigest, normal), np.uint64, len(normal)) | np.uint64(1)
    out[normal == ""] = 0
    return out


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts in a row, and where each text begins and ends (one more than texts); null texts have none."""
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    sizes = split.value_lengths().to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    table = _numbers(coded.dictionary)
    if not len(table):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    numbers = table[coded.indices.to_numpy()]
    real = numbers != 0
    edges = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(sizes)])]
    return numbers[real], edges


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of ``uint64`` (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_numbers(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of ``n`` words; the last ``n - 1`` places have none."""
    if len(numbers) < n:
        return np.zeros(0, np.uint64)
    last = len(numbers) - n + 1
    out = np.zeros(last, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + numbers[k : last + k])
    return out
