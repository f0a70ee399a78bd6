"""Token ids of whole texts by the `tokenizers` library, many texts at a time.

Words repeat, so a batch is split at ASCII white space, its distinct words are looked up, and only words
not known go through the tokenizer. Most words are rare: when the table of known words is full, only those
that several batches had stay. That gives the ids of the whole text for tokenizers whose
pre-tokenizer never joins what white space parts and that drop the white space, as `word_bpe_49k` does;
`Encoder` refuses others.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from pulsegrid.llm.common import on_release, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
WORDS_HELD = 700_000
_encoders: dict[tuple[str, int], "Encoder"] = {}
on_release(_encoders.clear)
# Letters for which lower case goes by single letters, so that a word and its point are two tokens.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_SEGMENT = 1 << 18


def encoder(path: str, words: int = WORDS_HELD) -> "Encoder":
    """The encoder of this Python worker; at most about `words` words stay known, from task to task."""
    if (path, words) not in _encoders:
        _encoders[path, words] = Encoder(path, words)
    return _encoders[path, words]


def _drops_white_space(description: dict) -> bool:
    steps = (description.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and "[^\\s" in first["pattern"].get("Regex", "")
        and not any(t["lstrip"] or t["rstrip"] for t in description.get("added_tokens", []))
        and not description.get("post_processor")
    )


class Encoder:
    def __init__(self, path: str, words: int = WORDS_HELD):
        with open(path, encoding="utf-8") as file:
            if not _drops_white_space(json.load(file)):
                raise ValueError(f"{path}: words of this tokenizer depend on the white space around them")
        self.tokenizer, self.held = Tokenizer.from_file(path), words
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        self.closes = np.zeros(self.size, bool)
        for piece, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.closes[number] = bool(suffix) and piece.endswith(suffix)
        self.marks = {"": [], **{m: self._ids([m])[0] for m in ".,"}}
        self._forget()

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _forget(self) -> None:
        """`known` gives words numbers; word i has the ids flat[begin[i]:begin[i] + length[i]]."""
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.batches = np.zeros(1 << 12, np.uint8)  # that had the word since the table was last full; 2 stands for more
        self.used = 0

    def _keep_common(self) -> None:
        """Forget the words that fewer than two batches had, or all if that leaves too many."""
        stay = np.flatnonzero(self.batches[: len(self.known)] > 1)
        if len(stay) > self.held // 2:
            self._forget()
            return
        words, lengths = list(self.known), self.length[stay]
        words, ids = [words[i] for i in stay.tolist()], self.flat[ragged(self.begin[stay], lengths)]
        self._forget()
        self._store(words, ids, lengths)

    def _add_plain(self, words: list[str]) -> None:
        """Words of letters as one text, which their last pieces part again."""
        ids = np.array(self._ids([" ".join(words)])[0], np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            self._add(words, self._ids(words))
            return
        self._store(words, ids, np.diff(ends, prepend=0))

    def _add(self, words: list[str], lists: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self._store(words, np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths)

    def _store(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        count, n = len(self.known), len(words)
        self.flat = _room(self.flat, self.used + len(ids))
        self.begin, self.length = _room(self.begin, count + n), _room(self.length, count + n)
        self.batches = _room(self.batches, count + n)
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[count : count + n] = self.used + np.cumsum(lengths) - lengths
        self.length[count : count + n] = lengths
        self.used += len(ids)
        self.known.update(zip(words, range(count, count + n)))

    def _learn(self, words: list[str]) -> None:
        """Words that are plain but for case and a point get the ids of their plain form."""
        known, bases, forms, odd = self.known, {}, {}, []
        for word in words:
            if word.isalpha() and word.isascii():
                base = word.lower()
                if base != word:
                    forms[word] = base, ""
                if base not in known:
                    bases[base] = None
                continue
            plain = _PLAIN.fullmatch(word)
            if plain:
                base = plain[1].lower()
                if base != word:
                    forms[word] = base, plain[2]
                if base not in known:
                    bases[base] = None
            else:
                odd.append(word)
        bases = list(bases)
        for at in range(0, len(bases), 1 << 12):
            self._add_plain(bases[at : at + (1 << 12)])
        for at in range(0, len(odd), 1 << 12):
            self._add(odd[at : at + (1 << 12)], self._ids(odd[at : at + (1 << 12)]))
        if forms:
            number = np.fromiter((known[base] for base, _ in forms.values()), np.int64, len(forms))
            mark = np.array([len(m) and 1 + ".,".index(m) for _, m in forms.values()])
            lengths = self.length[number]
            # The ids of the base and after them those of the mark.
            more = np.array([len(self.marks[m]) for m in ("", ".", ",")])[mark]
            ids = np.empty(int((lengths + more).sum()), np.uint32)
            tops = np.cumsum(lengths + more)
            first = tops - lengths - more
            ids[ragged(first, lengths)] = self.flat[ragged(self.begin[number], lengths)]
            for i, m in enumerate(".,"):
                at = first[mark == i + 1] + lengths[mark == i + 1]
                for k, value in enumerate(self.marks[m]):
                    ids[at + k] = value
            self._store(list(forms), ids, lengths + more)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.held:
            self._keep_common()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            words = [distinct[i] for i in fresh.tolist()]
            self._learn(words)
            number[fresh] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.batches[number] = np.minimum(self.batches[number] + 1, 2)
        return number[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]]; null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        ends = lists.offsets.to_numpy()
        words = lists.values
        numbers = self._numbers(words)
        lengths = self.length[numbers]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.empty(int(sums[-1]), np.uint32)
        for at in range(0, len(numbers), _SEGMENT):
            part = numbers[at : at + _SEGMENT]
            span = ragged(self.begin[part], lengths[at : at + _SEGMENT])
            ids[sums[at] : sums[at] + len(span)] = self.flat[span]
        return ids, sums[ends]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.zeros(max(size, 2 * len(array)), array.dtype)
    grown[: len(array)] = array
    return grown
