"""Token ids of whole texts, encoded once per distinct word.

Texts are cut where the tokenizer's own pattern always cuts: at blanks and line
feeds, and between a letter or digit and the ASCII punctuation that ends a word.
Each distinct part is encoded once and its ids are kept in a bounded cache; a
text's ids are then gathered with numpy. The ids equal those of the whole text.
"""

from __future__ import annotations

import json
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
#: Text bytes that are split at a time, words a worker remembers, and new words encoded at a time.
SLICE_BYTES, CACHE_WORDS, ENCODED_AT_ONCE = 3_000_000, 120_000, 4096
# Punctuation that is split off at the end of a word. Only behind Latin-1 letters,
# which neither normalization nor lower-casing turns into more than one character.
_WORD_END = r"([a-z0-9À-ÖØ-öø-ÿ])([,.#$%&*|]+)( |$)"


#: Ends a word inside :class:`LetterWords`; words that may hold it are not given to it.
_TERMINATOR = "\x01"
_SUFFIX = "</w>"
#: Words that are one piece for the tokenizer and that its normalizer leaves as they are.
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+").fullmatch


def _byte_names() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others shifted up."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class LetterWords:
    """Ids of many words of letters in one call, by the same merges with word ends as a byte of their own.

    The vocabulary's order is that of its merges, and a letter with the word's end comes
    before all of them, so a letter and the terminator merge first, as they should.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        names, end = _byte_names(), _TERMINATOR.encode()
        ranks = {}
        for token, number in vocabulary.items():
            known = all(c in names for c in token.removesuffix(_SUFFIX))
            if known:
                ranks[bytes(names[c] for c in token.removesuffix(_SUFFIX)) + end * token.endswith(_SUFFIX)] = number
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith(_SUFFIX)]] = True

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and how many each word has."""
        joined = _TERMINATOR.join(words) + _TERMINATOR
        ids = np.array(self.encoding.encode_ordinary(joined), np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)


class WordEncoder:
    """Ids of texts by a tokenizer for which blanks only separate words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = LetterWords(path)
        self.place: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _keep(self, parts: list[str]) -> None:
        """Forget all words but those of ``parts``; the common ones are among them."""
        known = [x for x in parts if x in self.place]
        at = np.fromiter((self.place[x] for x in known), np.int64, len(known))
        first, lengths = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        self.ids = self.ids[np.arange(total) + np.repeat(first - (ends - lengths), lengths)]
        self.starts = np.concatenate([[0], ends])
        self.place = dict(zip(known, range(len(known)), strict=True))

    def _places(self, parts: list[str]) -> np.ndarray:
        """Where each of the distinct parts stands in the cache, encoding new ones."""
        if len(self.place) > CACHE_WORDS:
            self._keep(parts)
        unknown = [x for x in parts if x not in self.place]
        plain = [x for x in unknown if _LETTERS(x)]
        new = [x for x in unknown if not _LETTERS(x)]
        flats, lengths = [self.ids], []
        for at in range(0, len(new), ENCODED_AT_ONCE):
            some = self.tokenizer.encode_batch_fast(new[at : at + ENCODED_AT_ONCE], add_special_tokens=False)
            ids = [e.ids for e in some]
            lengths += map(len, ids)
            flats.append(np.fromiter(chain.from_iterable(ids), np.uint32, sum(lengths[at:])))
        if plain:
            ids, counts = self.letters.encode(plain)
            flats.append(ids)
            lengths += counts.tolist()
        if unknown:
            new += plain
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate(flats)
        return np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more than texts); nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        parts = pc.split_pattern(pc.replace_substring_regex(plain, _WORD_END, r"\1 \2 "), " ")
        flat = parts.flatten().dictionary_encode()
        places = self._places(flat.dictionary.to_pylist())[flat.indices.to_numpy()]
        first, lengths = self.starts[places], self.starts[places + 1] - self.starts[places]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.arange(total) + np.repeat(first - (ends - lengths), lengths)
        words_before = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        return self.ids[gather], np.concatenate([[0], ends])[words_before]

    def slices(self, texts: pa.Array):
        """``encode`` over bounded slices: yields ids and offsets, texts in order."""
        sizes = pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // SLICE_BYTES
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(sizes)]])
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high > low:
                yield self.encode(texts.slice(low, high - low))


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
