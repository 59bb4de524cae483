"""Byte-level BPE encoding and decoding, with tree concatenation for long texts.

A text longer than `leaf` characters is cut into halves until the parts are
short enough; all parts of all texts are encoded in parallel, as rows of their
own. The parts of a text are then concatenated pairwise, up a tree: around each
join a window grows until both sides have a place where the pre-tokenizer cuts
whatever stands around it, the window between the two places is encoded again,
and it is taken when the ids outside agree exactly with those both sides have.
A run without any such place grows the window to the whole of its parts, so the
result is that of the whole text in every case.

Ids of words are looked up in a bounded cache per worker: a text whose words
are parted by single spaces encodes like its words one after the other, as a
space after a visible character always starts a new pre-token.

Defined results: a null text is an empty one; repeated rows give repeated
results; an empty table gives an empty result.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediarec.llm.common import text_of
from mediarec.llm.word_cache import ByteCache, portions
from mediarec.operators.staging import stage

LEAF = 16_384
_PAIRS = [p for w in b"\t\n\x0b\x0c\r " for p in (bytes([w, 32]), bytes([32, w]))]
# White space beyond ASCII; texts with any take the library's way.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Places where a byte-level pre-token ends in any context, told from two ASCII characters.
_CUT = re.compile(r"[!-~](?=[ \t-\r])|[A-Za-z](?=[0-9!-/:-@\[-`{-~])|[0-9](?=[A-Za-z!-/:-@\[-`{-~])")


def _uneven(data: bytes) -> bool:
    """Whether a space stands next to white space, or at an end."""
    return data[:1] == b" " or data[-1:] == b" " or any(p in data for p in _PAIRS)


class Encoder:
    """Whole-text encoding with a cache of words."""

    def __init__(self, path: str):
        self.path = path
        self.heads = ByteCache(path)
        self.rest = ByteCache(path, " ", like=self.heads)
        self.tokenizer = self.heads.tokenizer
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __reduce__(self):
        return Encoder, (self.path,)

    def whole(self, text: str) -> bytes:
        """Ids of `text` by the tokenizers library, as little-endian 32-bit bytes."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        split = [None if _uneven(d) or not t.isascii() and _WIDE.search(t) else d.split(b" ") for t, d in zip(texts, data)]
        self.heads.learn({s[0] for s in split if s})
        self.rest.learn(set().union(*[s[1:] for s in split if s]))
        return [self.whole(t) if s is None else self.heads.join(s[:1]) + self.rest.join(s[1:]) for t, s in zip(texts, split)]

    def decoded(self, ids: list[bytes]) -> list[str]:
        return self.tokenizer.decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)

    def _splits_added(self, text: str, at: int) -> bool:
        """Whether an added token stands across `at`."""
        return any(a in text[max(0, at - len(a) + 1):at + len(a) - 1] for a in self.added)

    def _place(self, text: str, low: int, high: int, last: bool) -> int | None:
        found = [m.end() for m in _CUT.finditer(text, low, high) if low < m.end() < high and not self._splits_added(text, m.end())]
        return None if not found else found[-1 if last else 0]

    def join(self, left: tuple[str, bytes], right: tuple[str, bytes]) -> tuple[str, bytes]:
        """Ids of the concatenated texts, from those of both."""
        (a, ids_a), (b, ids_b) = left, right
        text, at, size = a + b, len(a), 32
        while True:
            # Both window ends lie inside the sides' own texts, or are their ends.
            low, high = max(0, at - size), min(len(text), at + size)
            x = self._place(text, low, at, True)
            y = self._place(text, at, high, False)
            x = 0 if x is None and low == 0 else x
            y = len(text) if y is None and high == len(text) else y
            if x is not None and y is not None:
                tail, head = self.whole(text[x:at]), self.whole(text[at:y])
                whole_left, whole_right = x == 0, y == len(text)
                if (whole_left or ids_a.endswith(tail)) and (whole_right or ids_b.startswith(head)):
                    before = b"" if whole_left else ids_a[:len(ids_a) - len(tail)]
                    after = b"" if whole_right else ids_b[len(head):]
                    return text, before + self.whole(text[x:y]) + after
            size *= 2

    def tree(self, parts: list[tuple[str, bytes]]) -> bytes:
        while len(parts) > 1:
            paired = [self.join(*parts[i:i + 2]) for i in range(0, len(parts) - 1, 2)]
            parts = paired + parts[len(paired) * 2:]
        return parts[0][1]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_RESULT = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _results(key: pa.Array, ids: list[bytes], texts: list[str], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [key, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
         pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string())], names=[name, *_RESULT])


def _short(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        at = 0
        for run in portions(batch.column("text").to_pylist()):
            ids = own.many(run)
            yield _results(batch.column("doc_id").slice(at, len(run)), ids, own.decoded(ids), "doc_id")
            at += len(run)


def _leaves(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        at = 0
        for run in portions(batch.column("part").to_pylist()):
            keys = [batch.column(c).slice(at, len(run)) for c in ("row", "doc_id", "at", "part")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(own.many(run), pa.binary())], names=["row", "doc_id", "at", "part", "ids"])
            at += len(run)


def encoded_leaves(long: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """(row, doc_id, at, part, ids): the parts of long texts (row, doc_id, text), encoded on their own."""
    kind = long.schema["doc_id"].dataType.simpleString()
    # Halving until parts are at most `leaf` long gives 2**k parts.
    k = F.pow(2, F.ceil(F.log2(F.greatest(F.length("text") / leaf, F.lit(1.0))))).cast("int")
    step = F.ceil(F.length("text") / k).cast("int")
    sized = long.select("row", "doc_id", "text", k.alias("k"), step.alias("step"))
    parts = sized.select("row", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.substring(
        F.col("text"), i * F.col("step") + 1, F.col("step")))).alias("at", "part"))
    return parts.repartition("row", "at").mapInArrow(
        lambda batches: _leaves(batches, tokenizer), f"row bigint, doc_id {kind}, at int, part string, ids binary")


def digests(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of all `docs` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().alias("text"))
    out = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    short = texts.where(F.length("text") <= 2 * leaf).mapInArrow(lambda batches: _short(batches, tokenizer), out)
    # Written once, so that row numbers are the same in every later step and retry.
    long = stage(texts.where(F.length("text") > 2 * leaf).withColumn("row", F.monotonically_increasing_id()), "long-texts")

    def joined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = encoder(tokenizer)
        table = table.sort_by("at")
        ids = [own.tree(list(zip(table.column("part").to_pylist(), table.column("ids").to_pylist())))]
        batch = _results(pa.array([key[1].as_py()], table.schema.field("doc_id").type), ids, own.decoded(ids), "doc_id")
        return pa.Table.from_batches([batch])

    # A group is one document.
    whole = encoded_leaves(long, tokenizer, leaf).groupBy("row", "doc_id").applyInArrow(joined, out)
    return short.unionByName(whole)
