"""Row counts per user and per item, and the pruning loop built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row, functions as F

from mediarec.operators.skew import HOT_ROWS, hot_key_join
from mediarec.operators.staging import stage

# The pruning loop probes the pairs against the failed keys by broadcast while
# there are at most this many (ids are short strings: about 50 MB). The number
# is known from the previous round; beyond it the pairs are rewritten instead.
BROADCAST_KEYS = 500_000
# Likewise once the failed keys hold more than this share of the pair rows.
REWRITE_SHARE = 0.2
# Rounds in which at most this many keys fail read only the pairs of those keys,
# from two copies of the pairs laid out in folders by a hash of either key. A
# folder holds about FOLDER_ROWS rows; tables too small for two folders are read whole.
LATE_KEYS = 1_000
FOLDER_ROWS = 1_000_000
MAX_FOLDERS = 4_096


def pair_counts(df: DataFrame, dates: bool = False) -> DataFrame:
    """Rows per (user, item) as `n`, with `dates` also their first date as `first_ds`; rows without a user or item id are left out."""
    first = [F.min("ds").alias("first_ds")] if dates else []
    return (
        df.where(F.col("id_no").isNotNull() & F.col("media_id").isNotNull())
        .groupBy("id_no", "media_id").agg(F.count(F.lit(1)).alias("n"), *first)
    )


def _both_degrees(pairs: DataFrame) -> DataFrame:
    """(`side`, `key`, `n`): both degree tables out of one scan and one shuffle."""
    return (
        pairs.groupingSets([["id_no"], ["media_id"]], "id_no", "media_id")
        .agg(F.sum("n").alias("n"), F.grouping("id_no").alias("side"))
        .select("side", F.coalesce("id_no", "media_id").alias("key"), "n")
    )


def _users(degrees: DataFrame) -> DataFrame:
    return degrees.where(F.col("side") == 0).select(
        F.col("key").alias("id_no"), F.col("n").alias("itemCnt"))


def _items(degrees: DataFrame) -> DataFrame:
    return degrees.where(F.col("side") == 1).select(
        F.col("key").alias("media_id"), F.col("n").alias("userCnt"))


def degree_tables(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`id_no`, `itemCnt`) and (`media_id`, `userCnt`), written as one staged table."""
    degrees = stage(_both_degrees(pairs), "degrees")
    return _users(degrees), _items(degrees)


def attach_degrees(df: DataFrame, users: DataFrame, items: DataFrame,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of `df` whose user and item are both listed, with their counts.

    The counts double as the skew information of the two joins.
    """
    df = hot_key_join(df.drop("itemCnt", "userCnt"), items, "media_id", "userCnt", hot_rows)
    return hot_key_join(df, users, "id_no", "itemCnt", hot_rows)


def with_degree(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach rows-per-user (`itemCnt`) and rows-per-item (`userCnt`).

    Aggregates with map-side combine and joins back, in place of two windows
    that would sort all rows of a popular item in one task.
    """
    users, items = degree_tables(stage(pair_counts(df), "pairs"))
    return attach_degrees(df, users, items, hot_rows)


def _state(degrees: DataFrame, low: Column, done: int) -> tuple[DataFrame, Row]:
    """Write the key table of a round, marking keys that fail in it.

    (`side`, `key`, `n`, `failed`): rows of the key in this snapshot, and the
    round it failed in. The totals ride on the write; no second job reads it.
    """
    seen = Observation()
    now = F.col("failed") == done
    marked = degrees.withColumn("failed", F.coalesce("failed", F.when(low, F.lit(done))))
    table = stage(marked.observe(
        seen, F.count_if(now).alias("failing"),
        F.coalesce(F.sum(F.when(now, F.col("n"))), F.lit(0)).alias("cut"),
        F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("n"))), F.lit(0)).alias("rows")), "keys")
    return table, Row(**seen.get)


def _failed(state: DataFrame, side: int, key: str, name: str) -> DataFrame:
    return state.where((F.col("side") == side) & F.col("failed").isNotNull()).select(
        F.col("key").alias(key), F.col("failed").alias(name))


def _without(pairs: DataFrame, state: DataFrame, n_failed: int) -> DataFrame:
    for side, key in ((1, "media_id"), (0, "id_no")):
        gone = _failed(state, side, key, "_f").drop("_f")
        pairs = pairs.join(F.broadcast(gone) if n_failed <= BROADCAST_KEYS else gone, key, "left_anti")
    return pairs


def _folder(key: str, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


class _Folders:
    """Two copies of the pairs, in folders by a hash of the user and of the item; a copy is written when it is first needed."""

    def __init__(self, pairs: DataFrame, rows: int):
        self.pairs, self.count = pairs, min(MAX_FOLDERS, rows // FOLDER_ROWS)
        self.tables: dict[str, DataFrame] = {}

    def of(self, key: str, keys: list[str]) -> DataFrame:
        """The pairs of `keys`; only their folders are read."""
        if key not in self.tables:
            laid = self.pairs.withColumn("folder", _folder(key, self.count)).hint("rebalance", "folder")
            self.tables[key] = stage(laid, f"pairs-by-{key.replace('_', '-')}", "folder")
        spark = self.pairs.sparkSession
        kind = self.pairs.schema[key].dataType.simpleString()
        places = spark.createDataFrame([(k,) for k in keys], f"{key} {kind}").select(_folder(key, self.count).alias("f")).distinct().collect()
        return self.tables[key].where(F.col("folder").isin([r["f"] for r in places]) & F.col(key).isin(keys)).drop("folder")


def _touching(folders: _Folders, state: DataFrame, last: int) -> DataFrame:
    """The pairs of the keys that failed in round `last`, at most `LATE_KEYS` of them."""
    failing = state.where(F.col("failed") == last).select("side", "key").collect()
    users, items = ([r["key"] for r in failing if r["side"] == side] for side in (0, 1))
    parts = [folders.of("media_id", items)] if items else []
    if users:
        mine = folders.of("id_no", users)
        parts.append(mine.where(~F.col("media_id").isin(items)) if items else mine)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _after_round(pairs: DataFrame, state: DataFrame, last: int) -> DataFrame:
    """Key counts after the pairs that went with round `last` are taken off.

    Only those pairs are shuffled, as negative counts beside the old key table.
    """
    users, items = _failed(state, 0, "id_no", "_fu"), _failed(state, 1, "media_id", "_fi")
    went = pairs.join(F.broadcast(users), "id_no", "left").join(F.broadcast(items), "media_id", "left").where(
        F.least("_fu", "_fi") == last)
    less = -F.col("n")
    taken = went.select(F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("id_no").alias("key"), less.alias("n")),
        F.struct(F.lit(1).alias("side"), F.col("media_id").alias("key"), less.alias("n")))))
    return state.unionByName(taken, allowMissingColumns=True).groupBy("side", "key").agg(
        F.sum("n").alias("n"), F.min("failed").alias("failed"))


def core_keys(pairs: DataFrame, min_per_user: int, min_per_item: int,
              rounds: int | None = 5) -> tuple[DataFrame, DataFrame]:
    """Users and items left after `rounds` prunings (None: until nothing changes).

    `pairs` is a staged (`id_no`, `media_id`, `n`) table. In each round both
    counts come from the same snapshot and every key below its bound goes,
    with all its rows. A row therefore survives exactly when its user and its
    item never failed, so the state of the loop is one row per key. The first
    round counts everything; later ones scan the pairs and shuffle only those
    that just went. When much has gone, the pairs are rewritten and counted
    anew; when few keys fail, only the pairs of those keys are read. The driver
    sees three totals per round, and the keys of a round with few of them.

    The returned counts are those of the last snapshot that was filtered.
    """
    if rounds is not None and rounds < 1:
        raise ValueError("rounds must be at least 1")
    low = F.col("n") < F.when(F.col("side") == 0, min_per_user).otherwise(min_per_item)
    done = n_failed = cut = 0
    state = base_rows = folders = None
    while True:
        if state is None:
            degrees = _both_degrees(pairs).withColumn("failed", F.lit(None).cast("int"))
            n_failed, cut, base_rows, folders = 0, 0, None, None
        elif totals["failing"] <= LATE_KEYS and base_rows >= 2 * FOLDER_ROWS:
            folders = folders or _Folders(pairs, base_rows)
            degrees = _after_round(_touching(folders, state, done), state, done)
        else:
            degrees = _after_round(pairs, state, done)
        done += 1
        state, totals = _state(degrees, low, done)
        if done == rounds or not totals["failing"]:
            kept = state.where(F.col("failed").isNull() & (F.col("n") > 0))
            return _users(kept), _items(kept)
        base_rows = base_rows or totals["rows"]
        n_failed += totals["failing"]
        cut += totals["cut"]
        if n_failed > BROADCAST_KEYS or cut > REWRITE_SHARE * base_rows:
            pairs, state = stage(_without(pairs, state, n_failed), "pairs"), None


def core_filter(df: DataFrame, min_per_user: int, min_per_item: int,
                rounds: int | None = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose user and item pass `rounds` joint prunings, with both counts."""
    pairs = stage(pair_counts(df), "pairs")
    users, items = core_keys(pairs, min_per_user, min_per_item, rounds)
    return attach_degrees(df, users, items, hot_rows)
