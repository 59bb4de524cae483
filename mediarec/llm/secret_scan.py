"""Secret scan: fixed patterns, and strings that a battery of randomness tests can't tell from random ones.

Candidates are runs of 16 or more letters, digits, `+/` or `-_` (with up to two
`=` behind), and the parts of letters and digits in such runs. The encoding is the smallest
alphabet that holds the run: hexadecimal, base 32, 36 (one case), 62, 64 or 64
for URLs. Digits alone have none: numbers are even by nature.

The battery, on the symbols' places in the alphabet, each as a deviation from
what independent even symbols give:

* chi-squared: how even the alphabet is used;
* runs: changes between the lower and the upper half of the alphabet;
* serial correlation of neighbours.

The sum of the three squares is small for random strings, whatever the length.
Words give large sums, the larger the longer they are. So the null hypothesis is
"made like this corpus's words", and its distribution is counted: all words
shorter than a candidate are run together, document by document, cut into windows of each length
class and tested like the candidates. A candidate's p-value is the share of
windows of its alphabet and length class (its own length or shorter, which is
the safe side) with a sum as small. Short strings, which words resemble by
chance, get large p-values by that alone. Within each length class the procedure
of Benjamini and Hochberg then picks the p-values that keep the share of false
discoveries among those reported at `rate`.

Both tallies are one pass over all documents, summed by (alphabet, class, bin of
the sum): some thousand numbers, however large the corpus. They depend on the
documents alone, not on how tasks share them.

Patterns (leftmost, not overlapping, each on its own): `assign`, `access` and
`hex`; a random string that overlaps one of these spans isn't reported again.

Defined results: null and empty texts have no spans; null and repeated ids are
rows like others; places are code points; an empty table gives an empty result;
in a corpus without words no random string is reported.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The patterns, their shortest matches and the order of kinds.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")
_KEYWORDS = (b"passw", b"secret", b"token", b"api")  # one of them is in every match of ASSIGN, in some case

LEAST = 16
CLASSES = (16, 20, 24, 32, 40, 64)
BINS = 256
_CHUNK = 1 << 20
_DIGITS, _LOWER, _UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Alphabets in order of size; text of either case is read as the alphabet's only case.
FAMILIES = {"hex": _DIGITS + "abcdef", "base32": _LOWER + "234567", "base36": _DIGITS + _LOWER, "base62": _DIGITS + _UPPER + _LOWER,
            "base64": _DIGITS + _UPPER + _LOWER + "+/"}
_NAMES = list(FAMILIES)
_ENCODINGS = [(family, symbols.encode()) for family, symbols in (
    ("hex", _DIGITS + "abcdef"), ("hex", _DIGITS + "ABCDEF"), ("base32", _UPPER + "234567"), ("base36", _DIGITS + _LOWER), ("base36", _DIGITS + _UPPER),
    ("base62", _DIGITS + _UPPER + _LOWER), ("base64", _DIGITS + _UPPER + _LOWER + "+/"), ("base64", _DIGITS + _UPPER + _LOWER + "-_"))]
_PADDING = re.compile(rb"={0,2}")
_ALNUM = re.compile(rb"[A-Za-z0-9]{%d,}" % LEAST)


def _mask(symbols: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(symbols.encode())] = True
    return table


def _codes(family: str) -> np.ndarray:
    """Place of every byte in the alphabet, -1 outside."""
    symbols = FAMILIES[family]
    table = np.full(256, -1, np.int64)
    for i, c in enumerate(symbols):
        table[ord(c)] = i
        if family in ("hex", "base32", "base36"):
            table[ord(c.upper())] = i
    if family == "base64":
        table[ord("-")], table[ord("_")] = table[ord("+")], table[ord("/")]
    return table


_TOKEN, _HEX = _mask(_DIGITS + _LOWER + _UPPER + "+/-_"), _mask(_DIGITS + "abcdef")
_CODES = {f: _codes(f) for f in FAMILIES}


@dataclass(frozen=True)
class ScanConfig:
    rate: float = 0.01      # share of false discoveries allowed among random strings reported


def battery(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, symbols: int) -> np.ndarray:
    """Sum of the three squared deviations of each window of `codes`; windows follow one another without gaps."""
    n = sizes.astype(float)
    window = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(window * symbols + codes, minlength=len(sizes) * symbols).reshape(-1, symbols)
    chi = (counts.astype(float) ** 2).sum(1) * symbols / n - n
    even = (chi - (symbols - 1)) / np.sqrt(2 * (symbols - 1) * (n - 1) / n)
    inside = np.ones(len(codes), bool)
    inside[starts] = False
    high = codes >= symbols / 2
    changed, product = np.zeros(len(codes)), np.zeros(len(codes))
    changed[1:] = high[1:] != high[:-1]
    centred = codes - (symbols - 1) / 2
    product[1:] = centred[1:] * centred[:-1]
    changes = np.add.reduceat(changed * inside, starts)
    correlation = np.add.reduceat(product * inside, starts) / ((symbols ** 2 - 1) / 12)
    return even ** 2 + (changes - (n - 1) / 2) ** 2 / ((n - 1) / 4) + correlation ** 2 / (n - 1)


def _bins(sums: np.ndarray) -> np.ndarray:
    """Eight bins to a factor of e."""
    return np.clip((np.log(sums + 1e-9) * 8).astype(np.int64) + 128, 0, BINS - 1)


def _length_class(n: int) -> int:
    return max(i for i, c in enumerate(CLASSES) if c <= n)


def encoding(run: bytes) -> str | None:
    """The smallest alphabet that holds `run`."""
    if run.isdigit():
        return None
    return next((family for family, symbols in _ENCODINGS if not run.translate(None, symbols)), None)


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True of at least so many."""
    edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - starts >= least
    return starts[long], ends[long]


def candidates(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, str, int, int]]:
    """(start, end, alphabet, class, bin) of the strings to judge in the runs of `data`; whole runs come before their parts."""
    found = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        run = data[start:end]
        pieces = [(0, len(run))]
        if not run.isalnum():
            pieces += [m.span() for m in _ALNUM.finditer(run)]
        for a, b in pieces:
            piece = run[a:b]
            family = encoding(piece)
            if family is not None:
                codes = _CODES[family][np.frombuffer(piece, np.uint8)]
                value = battery(codes, np.array([0]), np.array([b - a]), len(FAMILIES[family]))
                found.append((start + a, start + b, family, _length_class(b - a), int(_bins(value)[0])))
    return found


_CYCLE = sum(CLASSES)
_ENDS = np.cumsum(CLASSES)


def word_windows(data: np.ndarray, words: np.ndarray, firsts: np.ndarray, family: str) -> tuple[np.ndarray, np.ndarray]:
    """(class, bin) of windows of the words in `data`, cut per document; `firsts` are the documents' first bytes.

    Windows of all classes take turns, so that every symbol is in one of them.
    """
    codes = np.where(words, _CODES[family][data], -1)
    used = codes >= 0
    per_doc = np.add.reduceat(used, firsts)
    codes = codes[used]
    # Whole cycles, then the windows of the last cycle that are full.
    whole, left = np.divmod(per_doc, _CYCLE)
    windows = whole * len(CLASSES) + np.searchsorted(_ENDS, left, side="right")
    total = int(windows.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(windows)), windows)
    number = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    cycle, kind = np.divmod(number, len(CLASSES))
    sizes = np.array(CLASSES)[kind]
    begin = (np.cumsum(per_doc) - per_doc)[doc] + cycle * _CYCLE + (_ENDS - CLASSES)[kind]
    # The symbols of full windows, one window after the other.
    starts = np.cumsum(sizes) - sizes
    place = np.repeat(begin - starts, sizes) + np.arange(int(sizes.sum()))
    return kind, _bins(battery(codes[place], starts, sizes, len(FAMILIES[family])))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(number of the first text, texts one after the other with line feeds between, where each starts)."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _CHUNK):
            size += len(texts[hi]) + 1
            hi += 1
        lengths = np.array([len(t) + 1 for t in texts[lo:hi]])
        yield lo, b"\n".join(texts[lo:hi]) + b"\n", np.cumsum(lengths) - lengths
        lo = hi


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of words (0) and candidates (1) by alphabet, length class and bin."""
    counts = np.zeros((2, len(_NAMES), len(CLASSES), BINS), np.int64)
    for batch in batches:
        for _, data, firsts in _chunks(_texts(batch)):
            array = np.frombuffer(data, np.uint8)
            token = _TOKEN[array]
            starts, ends = _runs(token, LEAST)
            for _, _, family, kind, bin_ in candidates(data, starts, ends):
                counts[1, _NAMES.index(family), kind, bin_] += 1
            for start, end in zip(starts, ends):
                token[start:end] = False
            for f, family in enumerate(_NAMES):
                kind, bins = word_windows(array, token, firsts, family)
                np.add.at(counts[0, f], (kind, bins), 1)
    at = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in at], pa.array(counts[at])], names=["what", "family", "kind", "bin", "n"])


def thresholds(counts: np.ndarray, rate: float) -> np.ndarray:
    """Largest bin reported per (alphabet, class), -1 for none, from counts by (words or candidates, alphabet, class, bin)."""
    words, found = counts
    p = (1 + words.cumsum(2)) / (1 + words.sum(2, keepdims=True))
    out = np.full(found.shape[:2], -1)
    for kind in range(found.shape[1]):
        own, here = p[:, kind].ravel(), found[:, kind].ravel()
        order = np.argsort(own, kind="stable")
        reported = here[order].cumsum()
        # Equal p-values stand or fall together: their last place counts.
        last = np.r_[own[order][1:] != own[order][:-1], True]
        fine = last & (reported > 0) & (own[order] * here.sum() <= rate * reported)
        if fine.any():
            limit = own[order][np.flatnonzero(fine)[-1]]
            out[:, kind] = (p[:, kind] <= limit).sum(1) - 1
    return out


def learn(docs: DataFrame, config: ScanConfig = ScanConfig()) -> np.ndarray:
    """Thresholds from all `docs` (text); the driver gets at most as many rows as there are alphabets, classes and bins."""
    counts = np.zeros((2, len(_NAMES), len(CLASSES), BINS), np.int64)
    names = ["what", "family", "kind", "bin"]
    for r in docs.select("text").mapInArrow(_tally, "what int, family int, kind int, bin int, n long").groupBy(*names).agg(F.sum("n").alias("n")).collect():
        counts[tuple(r[n] for n in names)] = r["n"]
    return thresholds(counts, config.rate)


Span = tuple[int, int, int]  # start, place of the kind, end


def _points(data: bytes, start: int, end: int) -> tuple[int, int]:
    """Code points before the two ends of an ASCII run."""
    before = len(data[:start].decode("utf-8", "surrogatepass"))
    return before, before + end - start


def _base(data: bytes, hexes: list[tuple[int, int]]) -> list[Span]:
    """Spans of the patterns in code points."""
    spans = []
    low = data.lower()
    if any(k in low for k in _KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data.decode("utf-8", "surrogatepass")) if len(m.group(2)) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data.decode("utf-8", "surrogatepass")) if m.end() - m.start() >= ACCESS_LEAST]
    for run in hexes:
        start, end = _points(data, *run)
        spans.append((start, 2, end))
    return spans


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(data: bytes, hexes: list[tuple[int, int]], judged: list[tuple[int, int, str, int, int]], limits: np.ndarray) -> tuple:
    """One text's row, from its hexadecimal runs and its candidates (both in bytes)."""
    base = _base(data, hexes)
    every = list(base)
    for start, end, family, kind, bin_ in judged:
        if bin_ > limits[_NAMES.index(family), kind]:
            continue
        end += len(_PADDING.match(data, end).group())
        a, b = _points(data, start, end)
        if all(b <= s or e <= a for s, _, e in every):
            every.append((a, 3, b))
    kinds = [k for _, k, _ in every]
    return (*[kinds.count(k) for k in range(3)], hashlib.sha256(_written(base).encode()).hexdigest(), _written(every), kinds.count(3))


def _scanning(limits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = _texts(batch), []
            for lo, data, firsts in _chunks(texts):
                array = np.frombuffer(data, np.uint8)
                token, hex_ = _runs(_TOKEN[array], LEAST), _runs(_HEX[array], HEX_LEAST)
                own: dict[int, tuple[list, list]] = {}
                for start, end in zip(*(x.tolist() for x in hex_)):
                    doc = int(np.searchsorted(firsts, start, side="right")) - 1
                    own.setdefault(doc, ([], []))[0].append((start - int(firsts[doc]), end - int(firsts[doc])))
                for start, end, *rest in candidates(data, *token):
                    doc = int(np.searchsorted(firsts, start, side="right")) - 1
                    own.setdefault(doc, ([], []))[1].append((start - int(firsts[doc]), end - int(firsts[doc]), *rest))
                for i in range(len(firsts)):
                    text = texts[lo + i]
                    rows.append(scan(text, *own.get(i, ([], [])), limits))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])
    return run


def spans(docs: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of `docs` (doc_id, text)."""
    limits = learn(docs, config)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scanning(limits), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
