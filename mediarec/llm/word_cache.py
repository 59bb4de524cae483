"""Token ids of words, looked up in a bounded cache that each Python worker keeps."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np


class WordCache:
    """Ids of words as little-endian unsigned 32-bit bytes, so that a text's ids are one join of its words' bytes.

    Right for tokenizers whose result for a text is that of its words one after
    the other; the caller decides what a word is, and what `prefix` stands
    before each. The cache starts anew when it holds `most` words, which bounds
    a worker's memory.
    """

    def __init__(self, path: str, prefix: str = "", most: int = 400_000, like: WordCache | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer
        self.path = path
        self.tokenizer = like.tokenizer if like else Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.prefix, self.most = prefix, most
        self.known: dict[bytes, bytes] = {}

    def __reduce__(self):
        # Sent to a worker, a cache starts empty.
        return type(self), (self.path, self.prefix, self.most)

    def encoded(self, words: list[bytes]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast([self.prefix + w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def learn(self, words: set[bytes]) -> None:
        new = list(words - self.known.keys())
        if not new:
            return
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(words)
        self.known.update(zip(new, self.encoded(new)))

    def join(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


# ASCII and Latin-1 letters.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"


def _byte_of() -> dict[str, int]:
    """The characters byte-level vocabularies write bytes as: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class RankedCache(WordCache):
    """A cache that encodes common words by `merge`, a quicker way to the same ids; `merge` is None where it may not be.

    Merging by the rank of the merged bytes gives the same ids as merging by
    the listed pairs if every token's own text encodes to that token (then the
    last two parts of a token are always its listed pair); this is checked when
    the vocabulary is read, and other vocabularies take the library's way. The
    word end, if the vocabulary has one, is written as a byte that UTF-8 never has.
    """

    _END = b"\xff"

    def __init__(self, path: str, prefix: str = "", most: int = 400_000, like: RankedCache | None = None):
        super().__init__(path, prefix, most, like)
        self.merge = like.merge if like else self._ranked()

    def _ranked(self):
        import tiktoken
        from tokenizers import models
        described = json.loads(self.tokenizer.to_str())["model"]
        end, vocab = described["end_of_word_suffix"], described["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in described["merges"]]
        inside = models.BPE(vocab=vocab, merges=pairs)
        special = set(self.tokenizer.get_added_tokens_decoder())
        byte, ranks = _byte_of(), {}
        for token, number in vocab.items():
            if number in special:
                continue
            closed = bool(end) and token.endswith(end) and token != end
            text = token[:-len(end)] if closed else token
            own = (self.tokenizer.model if closed else inside).tokenize(text)
            if [t.id for t in own] != [number]:
                return None
            ranks[bytes(byte[c] for c in text) + (self._END if closed else b"")] = number
        made = [vocab[a + b] for a, b in pairs]
        # Merges rank by number, after the single bytes and those that close a word.
        single = 512 if end else 256
        if made != sorted(made) or len(ranks) != len(pairs) + single or min(made) < single:
            return None
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def quick(self, word: str) -> list[int] | None:
        """Ids of a common word; None for others."""
        raise NotImplementedError

    def encoded(self, words: list[bytes]) -> list[bytes]:
        if self.merge is None:
            return super().encoded(words)
        ids = [self.quick(w.decode("utf-8", "surrogatepass")) for w in words]
        hard = [w for w, i in zip(words, ids) if i is None]
        rest = iter(super().encoded(hard) if hard else ())
        return [next(rest) if i is None else array("I", i).tobytes() for i in ids]


class LetterCache(RankedCache):
    """For lower-casing BPE with word ends.

    A word of ASCII or Latin-1 letters, perhaps with ASCII punctuation after
    it, is one pre-token, or two, and normalization only lowers its capitals.
    """

    _SIMPLE = re.compile(f"([{_LETTERS}]+)([!-/:-@\\[-`{{-~]*)")

    def _ranked(self):
        return super()._ranked() if json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"] and not self.prefix else None

    def quick(self, word: str) -> list[int] | None:
        m = self._SIMPLE.fullmatch(word)
        if not m:
            return None
        ids = self.merge(m[1].lower().encode() + self._END)
        return ids + self.merge(m[2].encode() + self._END) if m[2] else ids


class ByteCache(RankedCache):
    """For byte-level BPE whose pre-tokens are runs of letters, of digits and of marks, each with the space before it.

    Words of ASCII or Latin-1 letters, digits and marks but the apostrophe (which
    starts contractions) part where the kind changes; a single line end inside
    is one pre-token. Words that may hold an added token take the library's way.
    """

    # Possessive, so that no word is tried in more than one way.
    _KINDS = f"[{_LETTERS}]++|[0-9]++|[!-&(-/:-@\\[-`{{-~]++"
    _PLAIN = re.compile(f"([{_LETTERS}]+)([!-&(-;=-@\\[-`{{-~]*)")
    _SIMPLE = re.compile(f"(?:{_KINDS})(?:\n(?!\n)|{_KINDS})*+")
    _PARTS = re.compile(f" ?(?:{_KINDS})|\n")

    def _ranked(self):
        # Added tokens are told by their first two characters.
        told = all(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values())
        return super()._ranked() if told and not json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"] else None

    def quick(self, word: str) -> list[int] | None:
        m = self._PLAIN.fullmatch(word)
        if m:
            ids = self.merge((self.prefix + m[1]).encode())
            return ids + self.merge(m[2].encode()) if m[2] else ids
        if "<|" in word or not self._SIMPLE.fullmatch(word):
            return None
        ids = []
        for part in self._PARTS.findall(self.prefix + word):
            ids += self.merge(part.encode())
        return ids


_caches: dict[tuple, WordCache] = {}


def word_cache(path: str, prefix: str = "", kind: type[WordCache] = WordCache) -> WordCache:
    """The worker's cache of words with `prefix` before them, for the tokenizer file at `path`."""
    if (path, prefix, kind) not in _caches:
        _caches[path, prefix, kind] = kind(path, prefix)
    return _caches[path, prefix, kind]


def portions(texts: list, size: int = 1 << 20):
    """Runs of texts of about `size` characters, so that no step handles a whole batch at once."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t)
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run
