"""Whole texts to token ids, as the tokenizers library gives them, a column at a time.

The tokenizer of ``word_bpe_49k.json`` splits a text into words that never influence each other. So a batch of texts is
put in lower case and split by Arrow, each distinct word is encoded once by the library's model and kept, and the ids are
put together by NumPy.
Texts with rare characters, for which the split could differ from the library's, are encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The vocabulary file, the end id of a document, and the file's own split of a text in lower case into words.
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
WORD_SPLIT = r"('s|'t|'re|'ve|'m|'ll|'d|[^\s\pL\pN]+|\pN)"
#: Characters whose class is the same in every Unicode version since long; no white space but tab, LF, CR and blank.
PLAIN = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3c9}\x{410}-\x{44f}\x{2010}-\x{2027}\x{2030}-\x{203a}\x{20ac}]"
ADDED = r"<\|(startoftext|endoftext)\|>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def library_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def word_tokenizer(path: str):
    """The library with the same model, for words that are in lower case and split already."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer(library_tokenizer(path).model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... lengths[0] of them, then those of starts[1] and so on."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def plain_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts in normal form C, and which of them hold plain characters only and no added token."""
    values = texts.to_pylist()
    if not all(unicodedata.is_normalized("NFC", x) for x in values):
        texts = pa.array([unicodedata.normalize("NFC", x) for x in values], pa.large_string())
    odd = pc.or_(pc.match_substring_regex(texts, PLAIN), pc.match_substring_regex(texts, ADDED))
    return texts, ~odd.to_numpy(zero_copy_only=False)


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words in lower case, each word's place among them, and how many words each text has.

    Most stretches between white space come again and again, so each distinct one is lowered and split once.
    """
    stretches = pc.ascii_split_whitespace(texts)
    per_text = pc.list_value_length(stretches).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = stretches.flatten().dictionary_encode()
    split = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), WORD_SPLIT, r" \1 ")
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(split))
    per_stretch = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    sizes = per_stretch[at]
    places = coded.indices.to_numpy(zero_copy_only=False)[ragged((np.cumsum(per_stretch) - per_stretch)[at], sizes)]
    totals = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(per_text)])]
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), places, np.diff(totals)


@cache
def word_ends(path: str) -> np.ndarray:
    """Which ids end a word."""
    vocabulary = library_tokenizer(path).get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
    return ends


class WordEncoder:
    """Encodes batches of texts. Keeps the ids of the first max_words distinct words; others are encoded when they come.

    A task makes its own, so what it keeps goes with the task: some 50 MB at 250,000 words.
    """

    def __init__(self, path: str, max_words: int = 250_000):
        self.tokenizer, self.by_word, self.max_words, self.ends_word = library_tokenizer(path), word_tokenizer(path), max_words, word_ends(path)
        self.place: dict[str, int] = {"": 0}  # the split leaves an empty string at an end with white space
        self.n, self.used = 1, 0
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and how many each has: encoded as one text and cut after each id that ends a word."""
        ids = np.asarray(self.by_word.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) == len(words):
            return ids, np.diff(ends, prepend=-1)
        found = [np.asarray(e.ids, np.uint32) for e in self.by_word.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def _places(self, words: list[str]) -> tuple[np.ndarray, int, int]:
        """Where the ids of each word lie, and the n and used to which those go back after use that are not kept."""
        fresh = [w for w in words if w not in self.place]
        room = max(0, self.max_words - len(self.place))
        other: dict[str, int] = {}
        self._add(fresh[:room], self.place)
        back = self.n, self.used
        self._add(fresh[room:], other)
        place = self.place
        if not other:
            return np.fromiter(map(place.__getitem__, words), np.int64, len(words)), *back
        return np.fromiter((place[w] if w in place else other[w] for w in words), np.int64, len(words)), *back

    def _add(self, words: list[str], held: dict[str, int]) -> None:
        for k in range(0, len(words), 1 << 8):
            part = words[k : k + (1 << 8)]
            found, lengths = self._encode_words(part)
            end, used = self.n + len(part), self.used + len(found)
            while end > len(self.starts):
                self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
                self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
            while used > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.starts[self.n : end] = self.used + np.cumsum(lengths) - lengths
            self.lengths[self.n : end] = lengths
            self.ids[self.used : used] = found
            held.update(zip(part, range(self.n, end), strict=True))
            self.n, self.used = end, used

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts one after another, and the n + 1 bounds of each text's ids."""
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        texts, plain = plain_texts(texts.cast(pa.large_string()).fill_null(""))
        words, coded, counts = split_words(texts.filter(pa.array(plain)))
        own, *back = self._places(words)
        places = own[coded]
        ids = self.ids[ragged(self.starts[places], self.lengths[places])]
        per_word = np.concatenate([[0], np.cumsum(self.lengths[places])])
        self.n, self.used = back
        ends = np.cumsum(counts)
        sizes = np.zeros(n, np.int64)
        sizes[plain] = per_word[ends] - per_word[ends - counts]
        if plain.all():
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        odd = [np.asarray(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(~plain)]
        sizes[~plain] = [len(x) for x in odd]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(bounds[-1]), np.uint32)
        out[np.repeat(plain, sizes)] = ids
        out[~np.repeat(plain, sizes)] = np.concatenate(odd)
        return out, bounds

