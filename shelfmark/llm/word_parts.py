"""Token ids of single words, for tokenizers that treat every word between white space by itself."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa

#: Words and parts that a Python worker remembers before it starts anew.
REMEMBERED = 600_000

# What the file of a tokenizer must say for the cuts below to be safe.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"


def library_tokenizer(path: str):
    # Spark has a task for every core already
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts_at_white_space(path: str) -> bool:
    """Whether ids of a text are those of its words between ASCII white space, one after the other.

    True for byte-level BPE whose normalisation and pre-tokenization are the ones above, without dropout, whose
    added tokens all start with ``<|`` and neither hold nor take in white space.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, before = made["model"], made["pre_tokenizer"] or {}
    steps = before.get("pretokenizers", [])
    return (
        model["type"] == "BPE"
        and not model["dropout"]
        and (made["normalizer"] or {}).get("normalizers") == NORMALIZERS
        and len(steps) == 2
        and steps[0] == {"type": "Split", "pattern": {"Regex": PARTS}, "behavior": "Removed", "invert": True}
        and steps[1]["type"] == "ByteLevel"
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and all(
            t["content"].startswith(SPECIAL) and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"])
            for t in made["added_tokens"]
        )
    )


class Memory(dict):
    """What a worker has found out; halved, oldest first, when it grows beyond ``most`` entries."""

    def __init__(self, most: int = REMEMBERED):
        super().__init__()
        self.most = most

    def trim(self) -> None:
        if len(self) > self.most:
            newest = list(self.items())[len(self) // 2 :]
            self.clear()
            self.update(newest)


#: What separates words; and the first byte of characters beyond Latin-1.
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BEYOND = 0xC4


def distinct_words(raw: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts that lie end to end, the number of every word among them, and how many words each text has.

    ``starts`` also has the end of the last text.  A to Z become small letters, as normalisation would have it, but in words with
    characters beyond Latin-1, which it may compose, and in words with the beginning of a special string.
    """
    inside = _INSIDE[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    borders = starts[:-1][starts[:-1] < len(raw)]
    opens[borders] = inside[borders]
    first = np.flatnonzero(opens)
    per_text = np.bincount(np.searchsorted(starts, first, side="right") - 1, minlength=len(starts) - 1)
    if not len(first):
        return [], first, per_text
    letters = raw[inside]
    opened = np.flatnonzero(opens[inside])
    low = _LOWER[letters]
    odd = letters >= _BEYOND
    odd[:-1] |= (letters[:-1] == 0x3C) & (letters[1:] == 0x7C)
    for word in np.unique(np.searchsorted(opened, np.flatnonzero(odd), side="right") - 1).tolist():
        end = opened[word + 1] if word + 1 < len(opened) else len(letters)
        low[opened[word] : end] = letters[opened[word] : end]
    ends = np.append(opened, len(letters)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(opened), [None, pa.py_buffer(ends), pa.py_buffer(low)])
    numbered = words.dictionary_encode()
    return numbered.dictionary.to_pylist(), numbered.indices.to_numpy(), per_text


class WordParts:
    """Ids of words, by the tokenizer's own model.

    A word of ASCII and Latin-1 letters, digits and signs falls into parts as the tokenizer would cut it, and the model gives
    each part's ids; normalisation leaves such words as they are but for their case.  Any other word goes through the whole tokenizer.
    """

    #: Words that normalisation only lower-cases; in lower case, their parts.
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
    CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+").findall

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = library_tokenizer(path)
        self.model = self.tokenizer.model
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        #: byte-level models read each byte as a printable character
        self.letters = {b: chr(256 + k) for k, b in enumerate(others)}
        self.known = Memory(remembered)

    def _part(self, part: str) -> bytes:
        read = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(read)]).tobytes()

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of every word."""
        known, found, other = self.known, [], []
        for at, word in enumerate(words):
            text = word.decode()
            if (ids := known.get(text)) is not None:  # a word of one part
                found.append(ids)
            elif self.PLAIN(text) and SPECIAL not in text:
                ids = b""
                for part in self.CUT(text.lower()):
                    if (own := known.get(part)) is None:
                        own = known[part] = self._part(part)
                    ids += own
                found.append(ids)
            else:
                found.append(b"")
                other.append((at, text))
        known.trim()
        for (at, _), made in zip(other, self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False), strict=True):
            found[at] = np.array(made.ids, dtype="<u4").tobytes()
        return found


@cache
def word_parts(path: str, remembered: int = REMEMBERED) -> WordParts:
    """One for each Python worker, which serves many tasks."""
    return WordParts(path, remembered)
