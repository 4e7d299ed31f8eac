"""Ids of texts by a public tokenizer, each different word encoded once.

A batch of texts is cut into words and the words are numbered by Arrow, so Python sees a word once a
batch; the ids of a word are kept from batch to batch. A subclass says how texts fall into words
whose ids do not depend on their neighbours.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

from cohortlens.llm.common import Numbered, offsets_of, ragged

KEPT = 500_000  # different words kept from batch to batch
KEPT_CHARS = 30_000_000
JOINED = 500  # words that go to the tokenizer as one text


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker; the words that an encoder keeps go with its task."""
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def ranked(path: str) -> tiktoken.Encoding | None:
    """The vocabulary of a byte-level tokenizer as ranks; None if its merges are not in the order of its ids."""
    model = json.loads(tokenizer(path).to_str())["model"]
    special = set(tokenizer(path).get_added_tokens_decoder())
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if i not in special}
    made = [model["vocab"]["".join(pair)] for pair in model["merges"]]
    if made != sorted(made) or len(made) + 256 != len(ranks):
        return None
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parted(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The parts of all texts between spaces, numbered, and how many each text has (one at least)."""
    parts = pc.split_pattern(column, " ")
    counts = np.asarray(pc.list_value_length(parts)).astype(np.int64)
    return parts.flatten().dictionary_encode(), counts


class WordIds:
    """Texts to ids; see ``encode``."""

    def __init__(self, path: str):
        # the tasks of an executor are parallel already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizer(path)
        size = self.tokenizer.get_vocab_size()
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self._clear()

    def _clear(self) -> None:
        self.index, self.chars = Numbered(), 0
        self.ids, self.counts, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (by ``index``) of the words of all texts one after the other, and how many each text has."""
        raise NotImplementedError

    def joinable(self, words: list[str]) -> list[bool]:
        """Whether the ids of a word can be told apart in a text of many words."""
        raise NotImplementedError

    def together(self, groups: list[list[str]]) -> list[list[int]]:
        """Ids of the words of each group as one text."""
        raise NotImplementedError

    def borders(self, found: np.ndarray, words: list[str]) -> np.ndarray:
        """Where in the ids of joined words each word begins, and the end."""
        raise NotImplementedError

    def _alone(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and their number for each."""
        fine = self.joinable(words)
        together = [i for i, f in enumerate(fine) if f]
        apart = [i for i, f in enumerate(fine) if not f]
        order, ids, counts = [*together, *apart], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        groups = [[words[i] for i in together[k: k + JOINED]] for k in range(0, len(together), JOINED)]
        for group, whole in zip(groups, self.together(groups), strict=True):
            found = np.array(whole, np.uint32)
            ids.append(found)
            counts.append(np.diff(self.borders(found, group)))
        for each in self._alone([words[i] for i in apart]):
            ids.append(np.array(each, np.uint32))
            counts.append(np.array([len(each)], np.int64))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        starts = offsets_of(counts)[:-1]
        return ids[ragged(starts[back], counts[back])], counts[back]

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each text closed by ``end``, and their number for each text."""
        if len(self.index) > KEPT or self.chars > KEPT_CHARS:
            self._clear()
        if not len(self.index):
            self.index[None]  # stands for the end
            self.ids, self.counts = np.array([end], np.uint32), np.ones(1, np.int64)
        codes, words = self.words_of(column)
        fresh = list(self.index)[len(self.counts):] if len(self.index) > len(self.counts) else []
        if fresh:
            self.chars += sum(map(len, fresh))
            ids, counts = self._fresh(fresh)
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        self.starts = offsets_of(self.counts)[:-1]
        edges = np.cumsum(words)
        codes = np.insert(codes, edges, 0)
        lengths = self.counts[codes]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        edges = offsets_of(words + 1)
        return self.ids[ragged(self.starts[codes], lengths)], sums[edges[1:]] - sums[edges[:-1]]


#: Fixed value: how the tokenizer of word ends cuts a word into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
#: Words whose normal form and lower case are certain: ASCII and the letters of Latin-1.
CERTAIN = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch


class LowerWords(WordIds):
    """For the tokenizer that lower-cases and drops white space: words between spaces and line ends.

    Joined words are told apart by the ids that end a piece, since the number of pieces of each is
    known. Words with other characters, and those that may hold a special token, go one by one.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.ends = np.array([t.endswith("</w>") for t in self.tokens])

    def words_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = parted(pc.replace_substring(column, "\n", " "))
        numbers = self.index.codes([parts.dictionary.to_pylist()])
        return numbers[np.asarray(parts.indices)], counts

    def joinable(self, words: list[str]) -> list[bool]:
        return [CERTAIN(w) is not None and "<|" not in w for w in words]

    def together(self, groups: list[list[str]]) -> list[list[int]]:
        return self._alone([" ".join(g) for g in groups])

    def borders(self, found: np.ndarray, words: list[str]) -> np.ndarray:
        pieces = [1 if w.isalpha() else len(PIECES(normalize("NFC", w).lower())) for w in words]
        ends = np.concatenate([[0], np.flatnonzero(self.ends[found]) + 1])
        if len(ends) != sum(pieces) + 1 or ends[-1] != len(found):
            raise ValueError("the tokenizer cuts these words in another way than PIECES")
        return ends[offsets_of(np.array(pieces, np.int64))]


#: The white space of Unicode.
SPACE = r"\t-\r \x85\xa0  -     　"
CHUNKS = regex.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall


class SpacedWords(WordIds):
    """For the byte-level tokenizer, whose pieces may begin with one space: words with the space ahead.

    Its pattern never takes white space after another character, so a text may be cut ahead of a
    space, unless more white space stands there: only texts with two spaces in a row are cut by
    ``CHUNKS``. A joined word begins where an id's token does with a space. Joined words are encoded
    by the ranks of the same vocabulary where its merges are in the order of its ids, which is faster.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.ranked = ranked(path)
        self.begins = np.array([t.startswith("Ġ") for t in self.tokens])

    def words_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = parted(column)
        numbers = self.index.codes([[" " + w for w in parts.dictionary.to_pylist()]])
        codes = numbers[np.asarray(parts.indices)]
        firsts = offsets_of(counts)[:-1]
        leading = pc.list_element(pc.split_pattern(column, " ", max_splits=1), 0).to_pylist()
        codes[firsts] = self.index.codes([leading])
        odd = np.flatnonzero(np.asarray(pc.match_substring(column, "  ")))
        if len(odd):
            chunks = [CHUNKS(t) for t in column.take(pa.array(odd)).to_pylist()]
            n = np.array([len(c) for c in chunks], np.int64)
            starts, lengths = firsts.copy(), counts.copy()
            starts[odd], lengths[odd] = len(codes) + offsets_of(n)[:-1], n
            codes = np.concatenate([codes, self.index.codes(chunks)])[ragged(starts, lengths)]
            counts = lengths
        return codes, counts

    def joinable(self, words: list[str]) -> list[bool]:
        return [len(w) > 1 and w.rfind(" ") == 0 and "<|" not in w for w in words]

    def together(self, groups: list[list[str]]) -> list[list[int]]:
        if self.ranked:
            return [self.ranked.encode_ordinary("".join(g)) for g in groups]
        return self._alone(["".join(g) for g in groups])

    def borders(self, found: np.ndarray, words: list[str]) -> np.ndarray:
        starts = np.flatnonzero(self.begins[found])
        if len(starts) != len(words):
            raise ValueError("a joined word has not exactly one space")
        return np.append(starts, len(found))
