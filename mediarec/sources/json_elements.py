"""Elements of large JSON arrays and objects, read in byte ranges.

A file is one value. Spark's text reader cuts it at commas, in as many splits as
its size asks for and from any store Spark reads. Which commas separate elements
depends on what stands before them: inside a string or a deeper bracket they
don't. So a first pass sums up each split (for either start, inside a string or
not: where it ends and by how much the depth changes), the few rows of a file
are chained, and a second pass knows how every split begins. Elements that lie
across splits come out as fragments and are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

# A list's name, of at most 1,000 characters, before its first element.
_KEY = r'^[{\s]*"((?:[^"\\]|\\.){0,1000})"\s*:\s*\['
_MARK = re.compile(r'\\.|["{}\[\]]', re.S)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(`file`, `start`, `value`): text between commas, in order within each split."""
    return spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _after(piece: str, quoted: bool, depth: int) -> tuple[bool, int]:
    """Inside a string or not, and the depth, after `piece`."""
    for mark in _MARK.findall(piece):
        if mark == '"':
            quoted = not quoted
        elif not quoted and len(mark) == 1:
            depth += 1 if mark in "{[" else -1
    return quoted, depth


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        files, starts, values = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
        yield from zip(zip(files, starts), values)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: end state and change of depth from either start."""
    at, state, found = None, None, []

    def row():
        return (*at, state[0][0], state[0][1], state[1][0], state[1][1])

    for split, value in _rows(batches):
        if split != at:
            if at is not None:
                found.append(row())
            at, state = split, [(False, 0), (True, 0)]
        state = [_after(value, *s) for s in state]
    if at is not None:
        found.append(row())
    columns = list(zip(*found)) if found else [()] * 6
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "q0", "d0", "q1", "d1"])


def _begin(pieces: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """State at the start of every split; one row per split, of at least `maxPartitionBytes`, reaches the driver."""
    rows = pieces.mapInArrow(_summed, "file string, start long, q0 boolean, d0 int, q1 boolean, d1 int").collect()
    out, file, state = {}, None, (False, 0)
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, state = r["file"], (False, 0)
        out[r["file"], r["start"]] = state
        quoted, depth = state
        state = (r["q1"], depth + r["d1"]) if quoted else (r["q0"], depth + r["d0"])
    return out


def _cut(begin: dict, levels: int):
    """Elements of each split and what is left at its two ends: (file, start, no, kind, text); kinds: 0 head, 1 whole, 2 tail."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, no, held, found = None, 0, [], []
        quoted, depth, head = False, 0, False

        def put(kind: int) -> None:
            nonlocal no
            found.append((*at, no, kind, ",".join(held)))
            no += 1
            held.clear()

        for split, value in _rows(batches):
            if split != at:
                if at is not None and held:
                    put(0 if head else 2)
                at, no = split, 0
                quoted, depth = begin[split]
                head = quoted or depth > levels  # the element that comes first has begun before
            quoted, depth = _after(value, quoted, depth)
            held.append(value)
            if not quoted and depth <= levels:
                put(0 if head else 1)
                head = False
            if len(found) >= 10_000:
                yield _batch(found)
                found = []
        if at is not None and held:
            put(0 if head else 2)
        yield _batch(found)
    return run


def _batch(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "no", "kind", "text"])


def elements(spark: SparkSession, path: str, levels: int = 1) -> DataFrame:
    """(`file`, `start`, `no`, `text`): the elements of the array, or entries of the object, in each file of `path`.

    `text` has the brackets of the file's own array or object still on its first
    and last element. With `levels` 2 the lists inside an object are cut too.
    """
    pieces = _pieces(spark, path)
    begin = _begin(pieces)
    # One entry per split.
    parts = pieces.mapInArrow(_cut(begin, levels), "file string, start long, no long, kind int, text string")
    whole = parts.where("kind = 1").drop("kind")
    # A tail, the splits without an end after it, and the head that ends it; two rows per split at most.
    order = W.partitionBy("file").orderBy("start", "no")
    torn = parts.where("kind <> 1").withColumn("owner", F.sum((F.col("kind") == 2).cast("int")).over(order))
    glued = torn.groupBy("file", "owner").agg(
        F.min(F.struct("start", "no")).alias("first"), F.sort_array(F.collect_list(F.struct("start", "no", "text"))).alias("rows")).select(
        "file", "first.start", "first.no", F.array_join(F.transform("rows", lambda r: r["text"]), ",").alias("text"))
    return whole.unionByName(glued).where(F.trim(F.translate("text", "[]{}\n\r\t", "")) != "")


def array_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """Records of files that hold one JSON array of objects each."""
    text = F.regexp_replace(F.regexp_replace("text", r"^\s*\[", ""), r"\]\s*$", "")
    record = F.from_json(text, schema).alias("r")
    return elements(spark, path).select(record).select("r.*")


def object_entries(spark: SparkSession, path: str, kind: str = "int") -> DataFrame:
    """(`id`, `value`) of files that hold one JSON object each, used as dictionary."""
    text = F.regexp_replace(F.regexp_replace("text", r"^\s*\{", ""), r"\}\s*$", "")
    entry = F.from_json(F.concat(F.lit("{"), text, F.lit("}")), f"map<string,{kind}>")
    return elements(spark, path).select(F.explode(entry).alias("id", "value"))


def listed_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """`id` of the strings listed under `key` in files that hold one object of lists each.

    Only a list's first element has its key on it. The key each split goes on
    with is looked up first: keys are a file's few list names, not data.
    """
    parts = elements(spark, path, levels=2)
    named = parts.where(F.col("text").rlike(_KEY)).select("file", "start", "no", F.regexp_extract("text", _KEY, 1).alias("key")).collect()
    borders: dict[str, list] = {}
    for r in sorted(named, key=lambda r: (r["file"], r["start"], r["no"])):
        borders.setdefault(r["file"], []).append((r["start"], r["no"], r["key"]))
    # The stretches of (start, no) that belong to `key`.
    end = (2**63 - 1, 0)
    stretches = [(file, *mark[:2], *following[:2]) for file, marks in borders.items()
                 for mark, following in zip(marks, [*marks[1:], end]) if mark[2] == key]
    table = spark.createDataFrame(stretches, "f string, from_start long, from_no long, to_start long, to_no long")
    place = F.struct("start", "no")
    mine = (F.col("file") == F.col("f")) & (place >= F.struct("from_start", "from_no")) & (place < F.struct("to_start", "to_no"))
    bare = F.regexp_replace(F.regexp_replace("text", _KEY, ""), r"\]\s*\}?\s*$", "")
    return parts.join(table, mine).select(F.explode(F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>")).alias("id"))
