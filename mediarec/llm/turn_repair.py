"""Conversation structure repair: the cheapest edits that give `(s?(ua)+)?`, by integers as path weights.

A conversation's rows are Kept, Reroled, Deleted, or a row is Inserted. The
edits of a conversation are a path through a DAG whose nodes are (rows read,
grammar state, inserts made). One integer is a path's weight: its high digits
are the cost, below them follows one octal digit per edit, D=1 I=2 K=3 R=4 in
ASCII order, at the place the edit has in the audit and with zeros to the end.
So an ordinary minimum of integers picks the least cost and, among equals, the
ASCII-least audit, shorter ones first; the audit is read off the winner.

Inserts: replacing an insert and its neighbour in the result by a deletion of
that neighbour (and of a lone `s` that remains) costs at most 2 * delete more
than the insert saves, so where insert > 2 * delete no cheapest path has one.
The DAG has `EditCosts.inserts` layers of inserts: one, unless inserts are made
cheaper, where it bounds how many a conversation may get.

How it runs on Spark:

1. Damaged rows are counted per (conversation, turn, role, text), so copies are
   one row with a number; the first turn of every (conversation, role, text)
   tells repeats apart.
2. A range sort by conversation, turn, role and text deals rows out evenly, also
   those of one long conversation. Every task cuts its rows into blocks and
   writes, per block, the weights from each state on entry to each on exit.
3. The blocks of a conversation are chained by adding such weights: a few
   numbers per 512 rows, of three bits a row.
4. Blocks come back in order, each after its part of the audit, and are replayed
   and hashed as a stream. SHA-256 is a chain, so a conversation's blocks pass
   through one task, a block at a time.

Defined results: null roles and texts are one space; rows of equal turn stand in
the order of role, then text; a role whose first letter is not s, u or a can only be
reroled or deleted, an empty one too; a null conv_id is a conversation of its own; exactly
repeated rows are repeats like any others; a conversation without rows after
damage has zeros, an empty audit and the hash of the empty string; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from mediarec.llm.common import HAS_WORD
from mediarec.operators.staging import stage

BLOCK_ROWS = 512
BLOCK_CHARS = 1 << 20
STATES = 4                      # nothing yet, after s, after u, after a
ACCEPT = (0, 3)
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_TURN = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))  # what a new or reroled row becomes
_LETTERS = str.maketrans("1234", "DIKR")
_D, _I, _K, _R = 1, 2, 3, 4
_BITS = 3


@dataclass(frozen=True)
class EditCosts:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5          # on top, for a truncated row that is not deleted
    inserts: int = 1            # most inserts of a conversation; see above


Best = list[list[int | None]]   # [inserts][state]


def _less(a: int | None, b: int) -> int:
    return b if a is None or b < a else a


def _insert(best: Best, at: int, width: int, costs: EditCosts) -> None:
    """Let every path make inserts before row `at`."""
    for k in range(len(best) - 1):
        step = (costs.insert << _BITS * width) + (_I << _BITS * (width - 1 - at - k))
        for state, weight in enumerate(best[k]):
            if weight is not None:
                to = _TURN[state][0]
                best[k + 1][to] = _less(best[k + 1][to], weight + step)


def _edit(best: Best, row: tuple[str, bool, bool], at: int, width: int, costs: EditCosts) -> Best:
    """All paths after row `at`: (initial, must go, truncated)."""
    initial, gone, cut = row
    out: Best = [[None] * STATES for _ in best]
    more = costs.truncated if cut else 0
    for k, layer in enumerate(best):
        place, unit = _BITS * (width - 1 - at - k), _BITS * width
        drop = (costs.delete << unit) + (_D << place)
        keep = ((costs.keep + more) << unit) + (_K << place)
        turn = ((costs.rerole + more) << unit) + (_R << place)
        for state, weight in enumerate(layer):
            if weight is None:
                continue
            out[k][state] = _less(out[k][state], weight + drop)
            if gone:
                continue
            to = _AFTER[state].get(initial)
            if to is not None:
                out[k][to] = _less(out[k][to], weight + keep)
            to = _TURN[state][0]
            out[k][to] = _less(out[k][to], weight + turn)
    return out


def block_weights(rows: Sequence[tuple[str, bool, bool]], entry: int, costs: EditCosts) -> Best:
    """Least weights of the paths through `rows` from state `entry`, per inserts and state; audits have len(rows) + inserts places."""
    width = len(rows) + costs.inserts
    best: Best = [[None] * STATES for _ in range(costs.inserts + 1)]
    best[0][entry] = 0
    for at, row in enumerate(rows):
        _insert(best, at, width, costs)
        best = _edit(best, row, at, width, costs)
    return best


def chain(blocks: Sequence[tuple[int, Sequence[Best]]], costs: EditCosts) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the cheapest edits, and per block the state on entry and its part of the audit.

    A block is its number of rows and its weights from each state.
    """
    layers = costs.inserts
    best: Best = [[None] * STATES for _ in range(layers + 1)]
    best[0][0] = 0
    rows, back = 0, []
    for n, weights in blocks:
        own, width = _BITS * (n + layers), _BITS * (rows + n + layers)
        out: Best = [[None] * STATES for _ in best]
        came: list[list] = [[None] * STATES for _ in best]
        for k, layer in enumerate(best):
            for state, weight in enumerate(layer):
                if weight is None:
                    continue
                head = weight << _BITS * n
                for more in range(layers + 1 - k):
                    for to, tail in enumerate(weights[state][more]):
                        if tail is None:
                            continue
                        # The block's letters start after those before it: k inserts further on.
                        low = (tail & (1 << own) - 1) >> _BITS * k
                        total = head + ((tail >> own) << width) + low
                        if out[k + more][to] is None or total < out[k + more][to]:
                            out[k + more][to], came[k + more][to] = total, (k, state)
        back.append(came)
        best, rows = out, rows + n
    at_end = [list(layer) for layer in best]
    _insert(at_end, rows, rows + layers, costs)
    weight, k, state = min((w, k, s) for k, layer in enumerate(at_end) for s, w in enumerate(layer) if w is not None and s in ACCEPT)
    width = rows + layers
    audit = format(weight & (1 << _BITS * width) - 1, "o").zfill(width).rstrip("0").translate(_LETTERS)
    last = ""
    while weight != best[k][state]:  # inserts after the last row
        k -= 1
        state = next(s for s in range(STATES) if _TURN[s][0] == state and at_end[k][s] is not None and at_end[k][s]
                     + (costs.insert << _BITS * width) + (_I << _BITS * (width - 1 - rows - k)) == weight)
        weight, last = at_end[k][state], last + "I"
    parts, end, after = [], len(audit) - len(last), last
    for (n, _), came in zip(reversed(blocks), reversed(back)):
        before, entry = came[k][state]
        start = end - n - (k - before)
        parts.append((entry, audit[start:end] + after))
        end, k, state, after = start, before, entry, ""
    cost = min(w for layer in at_end for s, w in enumerate(layer) if w is not None and s in ACCEPT) >> _BITS * width
    return cost, parts[::-1]


def replay(rows: Sequence[tuple[str, str, int]], letters: str, state: int) -> Iterator[str]:
    """The repaired `role:text` of a block: rows are (role, text, copies), of which all but the first are deleted."""
    at = 0

    def inserted() -> Iterator[str]:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            state, role = _TURN[state]
            at += 1
            yield f"{role}:"

    for role, text, copies in rows:
        for _ in range(copies):
            yield from inserted()
            letter = letters[at]
            at += 1
            if letter == "K":
                state = _AFTER[state][role[0]]
                yield f"{role}:{text}"
            elif letter == "R":
                state, new = _TURN[state]
                yield f"{new}:{text}"
    yield from inserted()


def damaged(rows: DataFrame) -> DataFrame:
    """(`conv_id`, `turn`, `role`, `text`, `n`): rows after the damage their id and turn decide; `n` copies of a row."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       (F.crc32(key.cast("binary")) % 20).alias("code")).where("code <> 0")
    code = F.col("code")
    return rows.select(
        "conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(code == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("n"))


def _faults(rows: DataFrame) -> DataFrame:
    """Rows with `blank`, `first` (not seen earlier), `cut` and the initial, one per (conversation, turn, role, text)."""
    keys = ["conv_id", "turn", "role", "digest"]
    counted = stage(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
                    .withColumn("digest", F.sha2("text", 256)), "turns")
    # Nulls come first: the least of (has a turn, turn).
    first = counted.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"))).alias("least")).select(
        *[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "digest")], F.col("least.turn").alias("f_turn"), F.lit(True).alias("first"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return counted.join(first, same, "left").select(
        "conv_id", "turn", "role", "text", "n", F.coalesce("first", F.lit(False)).alias("first"),
        (~F.col("text").rlike(HAS_WORD)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), F.substring("role", 1, 1).alias("initial"))


_FACTS = "rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, start string, stop string"
_BLOCK = f"part int, block int, {_FACTS}, weights array<binary>, texts array<struct<role:string,text:string,n:long>>"


class _Block:
    """Rows of one conversation that follow one another."""

    def __init__(self, conv, key):
        self.conv, self.key = conv, key
        self.rows, self.texts, self.chars = [], [], 0
        self.facts = dict(blank=0, duplicate=0, truncated=0, illegal=0, turns=0, low=None, high=None, start="", stop="")

    def add(self, turn, role, text, n, first, blank, cut, initial):
        f = self.facts
        if not self.rows:
            f["start"] = initial
        else:
            f["illegal"] += f["stop"] + initial not in ("su", "ua", "au")
        f["illegal"] += n - 1
        f["stop"] = initial
        if turn is not None:
            f["turns"] += turn != f["high"]
            f["low"], f["high"] = turn if f["low"] is None else f["low"], turn
        gone = blank or not first
        f["blank"] += n if blank else 0
        f["duplicate"] += 0 if blank else n - first
        f["truncated"] += cut and not gone
        self.rows.append((initial, gone, cut))
        self.rows += [(initial, True, False)] * (n - 1)
        self.texts.append((role, None if gone else text, n))
        self.chars += len(role) + (0 if gone else len(text))

    def row(self, part, costs):
        weights = [block_weights(self.rows, s, costs) for s in range(STATES)]
        flat = [None if w is None else w.to_bytes(w.bit_length() // 8 + 1, "big") for best in weights for layer in best for w in layer]
        return (self.conv, part, self.key, len(self.rows), *self.facts.values(), flat, self.texts)


def _blocks(costs: EditCosts, schema: pa.Schema):
    """Rows in order, as blocks of one conversation each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, key = None, 0
        for batch in batches:
            found = []
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "first", "blank", "cut", "initial"))):
                if at is None or conv != at.conv or len(at.rows) >= BLOCK_ROWS or at.chars >= BLOCK_CHARS:
                    if at is not None:
                        found.append(at.row(part, costs))
                    at, key = _Block(conv, key), key + 1
                at.add(*row)
            yield _batch(found, schema)
        if at is not None:
            yield _batch([at.row(part, costs)], schema)
    return run


def _chained(conv, blocks: list[tuple], costs: EditCosts) -> list[tuple]:
    """One row per block of a conversation: its part of the edits, and the counts of the whole."""
    weights, own = [], costs.inserts + 1
    for b in blocks:
        flat = [None if w is None else int.from_bytes(w, "big") for w in b["weights"]]
        weights.append((b["rows"], [[flat[(s * own + k) * STATES:(s * own + k + 1) * STATES] for k in range(own)] for s in range(STATES)]))
    cost, parts = chain(weights, costs)
    total = {c: sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(a["stop"] + b["start"] not in ("su", "ua", "au") for a, b in zip(blocks, blocks[1:]))
    spans = [(b["turns"], b["low"], b["high"]) for b in blocks if b["turns"]]
    distinct = sum(t for t, _, _ in spans) - sum(a[2] == b[1] for a, b in zip(spans, spans[1:]))
    gaps = spans[-1][2] - spans[0][1] + 1 - distinct if spans else 0
    return [(conv, b["part"], b["block"], state, letters, gaps, *total.values(), cost) for b, (state, letters) in zip(blocks, parts)]


def _merged(costs: EditCosts, schema: pa.Schema):
    """Blocks in order of conversation: the edits of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, blocks = None, []
        for batch in batches:
            found = []
            for block in batch.to_pylist():
                if blocks and block["conv_id"] != conv:
                    found += _chained(conv, blocks, costs)
                    blocks = []
                conv = block["conv_id"]
                blocks.append(block)
            yield _batch(found, schema)
        if blocks:
            yield _batch(_chained(conv, blocks, costs), schema)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_EDITS = "part int, block int, state int, letters string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stream(schema: pa.Schema):
    """Blocks in order of conversation, each after its edits: one result per conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, counts, letters, hashed, edits = None, None, [], None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["letters"] is not None:
                    if counts is None or row["conv_id"] != conv:
                        if counts is not None:
                            found.append((conv, *counts, "".join(letters), hashed.hexdigest()))
                        conv, letters, hashed, empty = row["conv_id"], [], hashlib.sha256(), True
                    counts, edits = [row[c] for c in _COUNTS], (row["letters"], row["state"])
                    letters.append(row["letters"])
                    continue
                for line in replay([(t["role"], t["text"], t["n"]) for t in row["texts"]], *edits):
                    hashed.update((line if empty else f"\n{line}").encode("utf-8", "surrogatepass"))
                    empty = False
            yield _batch(found, schema)
        if counts is not None:
            yield _batch([(conv, *counts, "".join(letters), hashed.hexdigest())], schema)
    return run


def repaired(rows: DataFrame, costs: EditCosts = EditCosts()) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations with given rows.

    `rows` are (conv_id, turn, role, text, n) without null roles or texts; `n` counts copies.
    """
    kind = StructType([StructField("conv_id", rows.schema["conv_id"].dataType)])

    def schema(ddl: str) -> StructType:
        return StructType([*kind.fields, *StructType.fromDDL(ddl).fields])

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "text"]
    faulty = _faults(rows)
    # The sample of the range sort reaches the driver: it holds openings of texts only.
    dealt = faulty.repartitionByRange(tasks, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)
    made = schema(_BLOCK)
    blocks = stage(dealt.mapInArrow(_blocks(costs, to_arrow_schema(made)), made), "turn-blocks")
    edits = schema(_EDITS)
    in_order = ["conv_id", "part", "block"]
    narrow = blocks.drop("texts").repartition("conv_id").sortWithinPartitions(*in_order)
    merged = narrow.mapInArrow(_merged(costs, to_arrow_schema(edits)), edits)
    union = merged.unionByName(blocks.select("conv_id", "part", "block", "texts"), allowMissingColumns=True)
    ordered = union.repartition("conv_id").sortWithinPartitions(*in_order, F.col("letters").isNull())
    out = schema("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return ordered.mapInArrow(_stream(to_arrow_schema(out)), out)


def repair(conversations: DataFrame, costs: EditCosts = EditCosts()) -> DataFrame:
    """Every original conversation of `conversations` (conv_id, turn, role, text) after damage and repair."""
    found = repaired(damaged(conversations), costs)
    asked = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return asked.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_conv").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({key}, ''),
          lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""


def _path(state: str, cost: str, letter: str, line: str = "''") -> str:
    """A path as text: eight digits of cost, one letter per row so far, the repaired lines."""
    return (f"lpad(CAST(CAST(left({state}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({state}, 9, CAST(x[3] AS BIGINT) - 1)"
            f" || '{letter}' || substr({state}, 8 + CAST(x[3] AS BIGINT)) || {line}")


def oracle() -> str:
    """DuckDB SQL of `repair` with the default costs, without inserts: no cheapest path has any (see above)."""
    states = [f"acc[{i + 1}]" for i in range(STATES)]
    more = "CASE WHEN x[2] = 'truncated' THEN 5 ELSE 0 END"
    options: list[list[str]] = [[_path(s, "2", "D")] for s in states]
    for i, after in enumerate(_AFTER):
        for initial, to in after.items():
            options[to].append(f"CASE WHEN x[1] = '{initial}' AND x[2] NOT IN ('blank', 'duplicate') THEN "
                               + _path(states[i], more, "K", "chr(10) || x[4] || ':' || x[5]") + " END")
        to, role = _TURN[i]
        options[to].append("CASE WHEN x[2] NOT IN ('blank', 'duplicate') THEN "
                           + _path(states[i], f"1 + {more}", "R", f"chr(10) || '{role}:' || x[5]") + " END")
    step = ", ".join(f"least({', '.join(o)})" if len(o) > 1 else o[0] for o in options)
    # From the first state nothing leads back to it, so every list has a value to compare.
    return f"""
        WITH raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_CRC.format(key="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code
          FROM conversations),
        after AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw WHERE code <> 0),
        placed AS (SELECT *, left(role, 1) AS initial,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM after),
        judged AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
            CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
        counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
            list_reduce(list([initial, fault, CAST(i AS VARCHAR), role, text] ORDER BY i),
              lambda acc, x: [{step}], ['00000000', NULL, NULL, NULL]) AS acc, count(*) AS n FROM judged GROUP BY conv_id),
        won AS (SELECT *, least(acc[1], acc[4]) AS best FROM counted),
        asked AS (SELECT DISTINCT conv_id AS c FROM conversations)
        SELECT c AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
          coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 8) AS BIGINT), 0) AS cost,
          coalesce(substr(best, 9, n), '') AS audit, sha256(coalesce(substr(best, 10 + n), '')) AS repaired_sha256
        FROM asked LEFT JOIN won ON c IS NOT DISTINCT FROM conv_id"""
