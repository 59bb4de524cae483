"""ANSI SQL for the registered queries, written from the definitions for DuckDB."""

from __future__ import annotations

import math

# Fixed values, written out once more so that the two sides check each other.
MARKS = "-=+,#/?:^.@*\"※~ㆍ!』‘|()[]`'…》”“’·"
WIDTH = 8  # dimensions of the computed id vectors
K = 10

LOG_COLS = ("log_time", "watch_time", "id_no", "id_country", "age", "gender", "fraud_level",
            "media_id", "live", "duration", "ds")

CTES = {
    "log": """
        SELECT o_orderdate AS log_time, CAST(l_quantity * l_quantity * 4000 AS BIGINT) AS watch_time,
          CASE WHEN c_acctbal < -900 THEN NULL WHEN c_acctbal > 9900 THEN ''
               ELSE 'u' || o_custkey END AS id_no,
          CAST(c_nationkey AS VARCHAR) AS id_country, CAST(c_nationkey + 15 AS BIGINT) AS age,
          c_mktsegment AS gender,
          CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN CAST(1 AS BIGINT) ELSE 0 END AS fraud_level,
          'm' || l_partkey AS media_id, l_linenumber = 7 AS live,
          CASE WHEN p_size = 13 THEN CAST(0 AS BIGINT) ELSE p_size * 200000 END AS duration,
          CAST(o_orderdate AS DATE) AS ds
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
          JOIN customer ON o_custkey = c_custkey""",
    "meta": """
        SELECT 'm' || p_partkey AS media_id,
          CASE p_type WHEN 'ECONOMY' THEN 'ARTIS' WHEN 'LARGE' THEN 'DRAMA' WHEN 'MEDIUM' THEN 'ENTER'
            WHEN 'PROMO' THEN 'NEWS' WHEN 'SMALL' THEN 'SPORT' WHEN 'STANDARD' THEN 'ETC' END AS channel_category,
          p_brand AS channel_nm, p_name AS title
        FROM part WHERE p_brand <> 'Brand#7'""",
    "inv": """
        SELECT 'm' || p_partkey AS id, 'vision' AS modality FROM part WHERE p_size <> 21
        UNION ALL SELECT 'm' || p_partkey, 'audio' FROM part WHERE p_brand <> 'Brand#11'""",
    "clean": """
        SELECT *, CAST(watch_time AS DOUBLE) / nullif(duration, 0) AS score FROM log
        WHERE fraud_level = 0 AND NOT live AND id_no IS NOT NULL AND id_no <> ''
          AND watch_time BETWEEN 30000 AND 7200000
          AND CAST(watch_time AS DOUBLE) / nullif(duration, 0) >= 0.3""",
    "known": "SELECT * FROM clean WHERE media_id IN (SELECT media_id FROM meta)",
    "seen": "SELECT media_id, min(ds) AS upload_ds FROM known GROUP BY 1",
}


def _text(col: str) -> str:
    return f"CAST({col} AS VARCHAR) AS {col}"


def _r(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr}"


def _with(*names: str, **extra: str) -> str:
    """WITH clause of the named shared tables, then `extra` in order."""
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ", ".join(parts) + " "


LOG_OUT = "{t}(log_time), watch_time, {u}, id_country, age, gender, fraud_level, media_id, live, duration, {d}"


def _log_cols(user: str = "id_no") -> str:
    shown = {"log_time": _text("log_time"), "ds": _text("ds"), "id_no": user}
    return ", ".join(shown.get(c, c) for c in LOG_COLS)


SHOWN_USER = "coalesce(id_no, '(none)') AS id_no"
CLEAN = ("log", "meta", "clean", "known")

DEGREE = """SELECT *, count(media_id) OVER (PARTITION BY id_no) AS "itemCnt",
            count(id_no) OVER (PARTITION BY media_id) AS "userCnt" FROM {src}"""


def _rounds(n: int, src: str = "known", a: int = 9, b: int = 7) -> dict[str, str]:
    """Chain of n prunings: d<i> counts, k<i> keeps."""
    ctes = {}
    for i in range(1, n + 1):
        ctes[f"d{i}"] = DEGREE.format(src=src)
        ctes[f"k{i}"] = f'SELECT * FROM d{i} WHERE "itemCnt" >= {a} AND "userCnt" >= {b}'
        src = f"(SELECT {', '.join(LOG_COLS)}, score FROM k{i})"
    return ctes


def _day_split(src: str) -> dict[str, str]:
    """Day labels and the item assignment for the log rows in `src`."""
    return {
        "first_seen": f"SELECT media_id, min(ds) AS upload_ds FROM {src} GROUP BY 1",
        "days": "SELECT upload_ds, count(*) AS n FROM first_seen GROUP BY 1",
        "ratios": """SELECT upload_ds, CAST(sum(n) OVER (ORDER BY upload_ds) AS DOUBLE)
                     / CAST(sum(n) OVER () AS DOUBLE) AS r FROM days""",
        "labels_of": f"""SELECT upload_ds,
            CASE WHEN r > 0.95 THEN 'test' WHEN r >= 0.9 THEN 'valid'
                 WHEN {_bucket('upload_ds')} < 10 THEN 'test'
                 WHEN {_bucket('upload_ds')} < 19 THEN 'valid' ELSE 'train' END AS split,
            CASE WHEN r >= 0.9 THEN 'c_' ELSE 'w_' END AS wc FROM ratios""",
        "splitlog": f"""SELECT s.*, upload_ds, split, wc || split AS wc_split
            FROM {src} s JOIN first_seen USING (media_id) JOIN labels_of USING (upload_ds)""",
    }


def _bucket(day: str) -> str:
    return f"(CAST('0x' || substr(md5('42:' || CAST({day} AS VARCHAR)), 1, 8) AS BIGINT) % 100)"


SPLIT_LOG = _with(*CLEAN, **_day_split("known"))
SPLIT_COLS = f"{_log_cols()}, {_r('score')}, {_text('upload_ds')}, split, wc_split"

SLICES = {
    "slices": """
        SELECT split || '/total' AS slice, media_id, id_no, score FROM splitlog
        UNION ALL SELECT split || CASE WHEN starts_with(wc_split, 'c_') THEN '/cold' ELSE '/warm' END,
          media_id, id_no, score FROM splitlog
        UNION ALL SELECT 'test/total_' || channel_category, media_id, id_no, score
          FROM splitlog JOIN meta USING (media_id) WHERE split = 'test' AND channel_category <> 'ETC'
        UNION ALL SELECT 'test/' || CASE WHEN starts_with(wc_split, 'c_') THEN 'cold_' ELSE 'warm_' END
          || channel_category, media_id, id_no, score
          FROM splitlog JOIN meta USING (media_id) WHERE split = 'test' AND channel_category <> 'ETC'"""}


def _metrics(gt: str, pred: str, by: str = "", dedupe: bool = True, denominator: str = "n_rel") -> dict[str, str]:
    """Per-user metrics at 10 of the tables `gt` and `pred` as table `per_user`."""
    b = f"{by}, " if by else ""
    ideal = [sum(1 / math.log(1 + i) for i in range(1, n + 1)) for n in range(1, K + 1)]
    cases = " ".join(f"WHEN {n} THEN CAST({v!r} AS DOUBLE)" for n, v in enumerate(ideal, 1))
    n = "1" if dedupe else "count(*)"
    return {
        "truth": f"SELECT {b}id_no, media_id, {n} AS n FROM {gt} GROUP BY {b}id_no, media_id",
        "rel": f"SELECT {b}id_no, CAST(sum(n) AS BIGINT) AS n_rel FROM truth GROUP BY {b}id_no",
        "top": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {b}id_no
                   ORDER BY rating DESC, media_id) AS rk FROM {pred}) WHERE rk <= {K}""",
        "marked": f"""SELECT {b}id_no, rk, coalesce(n, 0) AS n,
                   sum(coalesce(n, 0)) OVER (PARTITION BY {b}id_no ORDER BY rk) - coalesce(n, 0) AS bef
                   FROM top LEFT JOIN truth USING ({b}id_no, media_id)""",
        "sums": f"""SELECT {b}id_no, CAST(sum(n) AS BIGINT) AS hits, sum(n / ln(1.0 + rk)) AS dcg,
                   sum((n * bef + n * (n + 1) / 2.0) / rk) AS ap FROM marked GROUP BY {b}id_no""",
        "per_user": f"""SELECT {b}id_no, hits, n_rel, hits / {K}.0 AS precision, hits / n_rel AS recall,
                   dcg / CASE least(n_rel, {K}) {cases} END AS ndcg, ap / {denominator} AS map
                   FROM sums JOIN rel USING ({b}id_no)""",
    }


def _averaged(by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""SELECT {b}count(*) AS n_users, {_r('avg(precision)', 'precision')}, {_r('avg(recall)', 'recall')},
               {_r('avg(ndcg)', 'ndcg')}, {_r('avg(map)', 'map')} FROM per_user""" + (f" GROUP BY {by}" if by else "")


PREDICTION = {"pred": """SELECT id_no, media_id, CAST(max(watch_time) AS DOUBLE) AS rating FROM log
                         WHERE id_no IS NOT NULL AND id_no <> '' GROUP BY 1, 2"""}


def _id_vector(col: str, phase: int) -> str:
    return "[" + ", ".join(f"sin(CAST(substr({col}, 2) AS DOUBLE) * {j} + {phase})" for j in range(1, WIDTH + 1)) + "]"


# Embeddings in rows and their four modalities.
VEC = "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings"
FEATURES = """
    SELECT id AS item_id, 'vision' AS modality, vec[1:32] AS vec FROM v
    UNION ALL SELECT id, 'audio', vec[33:48] FROM v
    UNION ALL SELECT id, 'lyrics', vec[49:64] FROM v
    UNION ALL SELECT id, 'genres', list_transform(range(0, 10), lambda i: CASE WHEN i = label THEN 1.0 ELSE 0.0 END)
      FROM v"""
PLANTED = "SELECT id, [" + ", ".join(
    "CAST(list_sum(list_transform(range(1, 65), lambda i: vec[i] * sin(i * {j}))) AS FLOAT)::DOUBLE".format(j=j)
    for j in range(1, WIDTH + 1)) + "] AS cf FROM v"


def _elements(src: str, vec: str, *keys: str) -> str:
    k = "".join(f"{x}, " for x in keys)
    return (f"SELECT {k}CAST(dim - 1 AS BIGINT) AS dim, {_r('val')} FROM "
            f"(SELECT {k}unnest({vec}) AS val, generate_subscripts({vec}, 1) AS dim FROM {src})")


WHITE_SPACE = ("[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
               "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+")
TEXT = "coalesce(text, '') || ' ' || array_to_string([lang, source], ', ')"


def _cleaned(expr: str) -> str:
    chars = MARKS.replace("'", "''")
    return (f"trim(regexp_replace(translate({expr}, '{chars}', '{' ' * len(MARKS)}'), "
            f"'{WHITE_SPACE}', ' ', 'g'))")


SEQ = """SELECT CAST(floor(vec_id / 25) AS BIGINT) AS item_id, CAST(vec_id % 25 AS BIGINT) AS pos,
         CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings"""

ASKED = "SELECT CAST(doc_id AS VARCHAR) AS id FROM labels"


def oracle_sql() -> dict[str, str]:
    log = _with("log")
    known = _with(*CLEAN)
    score = "CAST(watch_time AS DOUBLE) / nullif(duration, 0)"
    degree_cols = f'{_log_cols()}, {_r("score")}, "itemCnt", "userCnt"'
    days = known + f", seen AS ({CTES['seen']}), days AS (SELECT upload_ds, count(*) AS n FROM seen GROUP BY 1) "
    ratio = """SELECT {cols} FROM (SELECT upload_ds, n AS count, {total} AS total,
        CAST(sum(n) OVER (ORDER BY upload_ds) AS BIGINT) AS cumsum FROM days)"""
    ratio_cols = f"{_text('upload_ds')}, count, total, cumsum, {_r('cumsum / total', 'cum_ratio')}"
    total = "CAST(sum(n) OVER () AS BIGINT)"
    wrap = ratio.format(cols="*, cumsum / total AS r", total=total)
    vec, feats = f"WITH v AS ({VEC}) ", f"WITH v AS ({VEC}), f AS ({FEATURES}), p AS ({PLANTED}), asked AS ({ASKED}) "
    wide = """SELECT a.vec AS vision, b.vec AS audio, c.vec AS lyrics, d.vec AS genres, cf, a.item_id
        FROM f a JOIN f b USING (item_id) JOIN f c USING (item_id) JOIN f d USING (item_id)
        JOIN p ON p.id = a.item_id
        WHERE a.modality = 'vision' AND b.modality = 'audio' AND c.modality = 'lyrics' AND d.modality = 'genres'"""
    frames = "SELECT id, CAST(f AS BIGINT) AS frame, list_transform(range(1, 11), lambda i: coalesce(x[f * 10 + i], 0.0)) AS s FROM sig, range(0, {n}) r(f)"
    train_scores = SPLIT_LOG + """SELECT id_no, media_id{ds}, {score} FROM splitlog WHERE split = 'train'
        GROUP BY id_no, media_id{day}"""
    n_rows = _rounds(5)
    balanced = {
        **n_rows,
        "pool": """SELECT media_id, row_number() OVER (PARTITION BY channel_category ORDER BY media_id) AS rn
            FROM meta WHERE channel_category IN ('ARTIS', 'DRAMA', 'ENTER', 'NEWS', 'SPORT')
              AND media_id IN (SELECT media_id FROM k5)""",
        "balanced": "SELECT * FROM k5 WHERE media_id IN (SELECT media_id FROM pool WHERE rn <= 200)",
        **_day_split("balanced"),
    }
    complete = """media_id IN (SELECT id FROM inv WHERE modality = 'vision')
        AND media_id IN (SELECT id FROM inv WHERE modality = 'audio')"""
    complete_log = {**{k: q for k, q in balanced.items() if k != "splitlog"}, "alllog": balanced["splitlog"],
                    "splitlog": f"SELECT * FROM alllog WHERE {complete}"}
    user_meta = f"""SELECT id_no, count(*) AS count, CAST(max(ds) AS VARCHAR) AS last_ds,
            CAST(min(ds) AS VARCHAR) AS start_ds, {_r('avg(watch_time)', 'avg_watch_time')}, max(age) AS age,
            max(gender) AS gender, date_diff('day', min(ds), max(ds)) AS "dateDiff" FROM {{}} GROUP BY 1"""
    # What an ALS model must know, whatever its factors: who has one, from how many rows.
    day = "SELECT id_no, media_id, ds, sum(score) AS score FROM splitlog WHERE split = 'train' GROUP BY 1, 2, 3"
    tracks = """SELECT l_orderkey, l_linenumber <> 7 AS counted, 't' || l_partkey IN (SELECT 't' || substr(media_id, 2) FROM meta) AS listed
        FROM lineitem"""
    content = {
        "v": VEC, "p": PLANTED,
        "su": f"SELECT slice, id_no, {_id_vector('id_no', 0)} AS uv FROM (SELECT DISTINCT slice, id_no FROM slices)",
        "si": "SELECT slice, media_id, cf AS iv FROM (SELECT DISTINCT slice, media_id FROM slices) LEFT JOIN p ON 'm' || id = media_id",
        "pred": """SELECT slice, id_no, media_id, round(list_cosine_similarity(uv, iv), 12) AS rating
            FROM su JOIN si USING (slice) WHERE iv IS NOT NULL""",
        "gone": "SELECT slice, count(*) FILTER (iv IS NULL) AS items_missing FROM si GROUP BY 1",
    }
    index = "SELECT {c} AS id, row_number() OVER (ORDER BY {c}) - 1 AS idx, n FROM (SELECT {c}, count(*) AS n FROM {t} GROUP BY 1)"
    steps = ["TRUE", "fraud_level = 0", "NOT live", "id_no IS NOT NULL AND id_no <> ''",
             "watch_time BETWEEN 30000 AND 7200000", f"{score} >= 0.3",
             "media_id IN (SELECT media_id FROM meta)"]
    names = ["raw", "not_fraud", "not_live", "user_present", "watch_time", "score", "in_catalogue"]
    funnel = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS stage_no, '{s}' AS stage, count(*) AS rows, count(DISTINCT media_id) AS items"
        f" FROM log WHERE {' AND '.join(steps[:i + 1])}" for i, s in enumerate(names))
    manifest_of = {
        "all_item": ("media_id", "TRUE"), "cold_item": ("media_id", "starts_with(wc_split, 'c_')"),
        "warm_item": ("media_id", "starts_with(wc_split, 'w_')"), "all_user": ("id_no", "TRUE"),
        "cold_user": ("id_no", "starts_with(wc_split, 'c_')"), "warm_user": ("id_no", "starts_with(wc_split, 'w_')")}
    manifest = " UNION ALL ".join(
        f"SELECT DISTINCT split, '{s}' AS id_set, {c} AS id FROM splitlog WHERE {w}"
        for s, (c, w) in manifest_of.items())
    slice_pred = {
        "su": f"SELECT slice, id_no, {_id_vector('id_no', 0)} AS uv FROM (SELECT DISTINCT slice, id_no FROM slices)",
        "si": f"SELECT slice, media_id, {_id_vector('media_id', 1)} AS iv FROM (SELECT DISTINCT slice, media_id FROM slices)",
        "pred": "SELECT slice, id_no, media_id, round(list_cosine_similarity(uv, iv), 12) AS rating FROM su JOIN si USING (slice)",
    }
    none_missing = "SELECT *, CAST(0 AS BIGINT) AS users_missing, CAST(0 AS BIGINT) AS items_missing FROM ({})"
    return {
        "project_log": log + f"SELECT {_log_cols(SHOWN_USER)} FROM log",
        "drop_fraud": log + f"SELECT {_log_cols(SHOWN_USER)} FROM log WHERE fraud_level = 0",
        "drop_live": log + f"SELECT {_log_cols(SHOWN_USER)} FROM log WHERE NOT live",
        "require_key": log + f"SELECT {_log_cols()} FROM log WHERE id_no IS NOT NULL AND id_no <> ''",
        "with_score": log + f"SELECT {_log_cols(SHOWN_USER)}, {_r(f'coalesce({score}, -1.0)', 'score')} FROM log",
        "watch_time_between": log + f"SELECT {_log_cols(SHOWN_USER)} FROM log WHERE watch_time BETWEEN 30000 AND 7200000",
        "min_score": log + f"SELECT {_log_cols(SHOWN_USER)}, {_r(score, 'score')} FROM log WHERE {score} >= 0.3",
        "static_filter": _with(*CLEAN, d=DEGREE.format(src="known")) + f"SELECT {degree_cols} FROM d",
        "filter_funnel": _with("log", "meta") + funnel,
        "common_items": _with("log", "meta", "clean")
        + "SELECT media_id FROM clean INTERSECT SELECT media_id FROM meta",
        "keep_items": known + f"SELECT {_log_cols()}, {_r('score')} FROM known",
        "where_category": _with("meta") + "SELECT * FROM meta WHERE channel_category IN ('NEWS', 'SPORT')",
        "pair_counts": _with("log", "clean") + "SELECT id_no, media_id, count(*) AS n FROM clean GROUP BY 1, 2",
        "with_degree": _with(*CLEAN, d=DEGREE.format(src="known")) + f"SELECT {degree_cols} FROM d",
        "core_filter_5": _with(*CLEAN, **_rounds(5)) + f"SELECT {degree_cols} FROM k5",
        "core_filter_fixpoint": _with(*CLEAN, **_rounds(32)) + f"SELECT {degree_cols} FROM k32",
        "view_counts": known + "SELECT media_id, count(*) AS count FROM known GROUP BY 1",
        "view_counts_user": known + "SELECT id_no, count(*) AS count FROM known GROUP BY 1",
        "item_meta": _with("log", "meta", "clean") + f"""SELECT m.*, count, {_r('avg_watch_time')} FROM meta m JOIN
            (SELECT media_id, count(*) AS count, avg(watch_time) AS avg_watch_time FROM clean GROUP BY 1) USING (media_id)""",
        "user_meta": known + user_meta.format("known"),
        "summary": known + """SELECT count(*) AS rows, count(DISTINCT media_id) AS items,
            count(DISTINCT id_no) AS users FROM known""",
        "category_summary": _with("meta") + "SELECT channel_category, count(*) AS count FROM meta GROUP BY 1",
        "distinct_ids": log + "SELECT DISTINCT id_no FROM log WHERE id_no IS NOT NULL",
        "balance_by_category": _with("meta") + """SELECT media_id, channel_category, channel_nm, title FROM (
            SELECT *, row_number() OVER (PARTITION BY channel_category ORDER BY media_id) AS rn FROM meta
            WHERE channel_category IN ('ARTIS', 'DRAMA', 'ENTER', 'NEWS', 'SPORT')) WHERE rn <= 100""",
        "item_first_seen": known + "SELECT media_id, CAST(min(ds) AS VARCHAR) AS upload_ds FROM known GROUP BY 1",
        "items_per_day": days + f"SELECT {_text('upload_ds')}, n AS count FROM days",
        "cumulative_ratio": days + ratio.format(cols=ratio_cols, total=total),
        "cumulative_ratio_literal": days + ratio.format(cols=ratio_cols, total="CAST(50000 AS BIGINT)"),
        "temporal_split": days + f"""SELECT {ratio_cols}, split, 'c_' || split AS wc_split FROM (SELECT *,
            CASE WHEN r > 0.95 THEN 'test' WHEN r >= 0.9 THEN 'valid' ELSE 'train' END AS split FROM ({wrap}))""",
        "warm_split": days + f"""SELECT {_text('upload_ds')}, count, split, 'w_' || split AS wc_split FROM (
            SELECT upload_ds, n AS count, CASE WHEN {_bucket('upload_ds')} < 10 THEN 'test'
            WHEN {_bucket('upload_ds')} < 19 THEN 'valid' ELSE 'train' END AS split FROM days)""",
        "assign_splits": SPLIT_LOG + f"SELECT {SPLIT_COLS} FROM splitlog",
        "where_split_warm": SPLIT_LOG + f"SELECT {SPLIT_COLS} FROM splitlog WHERE wc_split = 'w_test'",
        "where_split_cold": SPLIT_LOG + f"SELECT {SPLIT_COLS} FROM splitlog WHERE wc_split = 'c_test'",
        "prepare_dataset": _with(*CLEAN, "inv", **balanced)
        + f'SELECT {SPLIT_COLS}, "itemCnt", "userCnt" FROM splitlog WHERE {complete}',
        "core_log": _with(*CLEAN, **_rounds(5)) + f"SELECT {degree_cols} FROM k5",
        "prepare_item_table": _with(*CLEAN, "inv", **balanced) + f"""SELECT media_id, "userCnt", channel_category, {_text('upload_ds')}, split, wc_split,
            {complete} AS complete FROM (SELECT DISTINCT media_id, "userCnt", upload_ds, split, wc_split FROM splitlog) JOIN meta USING (media_id)""",
        "prepare_item_meta": _with(*CLEAN, "inv", **balanced) + f"""SELECT m.*, count, {_r('avg_watch_time')} FROM meta m JOIN
            (SELECT media_id, count(*) AS count, avg(watch_time) AS avg_watch_time FROM splitlog WHERE {complete} GROUP BY 1) USING (media_id)""",
        "prepare_slices": _with(*CLEAN, "inv", **complete_log, **SLICES)
        + f"SELECT slice, media_id, id_no, {_r('score')} FROM slices",
        "prepare_manifest": _with(*CLEAN, "inv", **complete_log) + f"SELECT * FROM ({manifest})",
        "prepare_user_meta": _with(*CLEAN, "inv", **balanced) + user_meta.format("splitlog"),
        "split_summary": _with(*CLEAN, **balanced) + """SELECT split, wc_split, count(*) AS rows,
            count(DISTINCT media_id) AS items, count(DISTINCT id_no) AS users FROM splitlog GROUP BY 1, 2""",
        "export_slices": _with(*CLEAN, **_day_split("known"), **SLICES)
        + f"SELECT slice, media_id, id_no, {_r('score')} FROM slices",
        "split_manifest": SPLIT_LOG + manifest,
        "user_histories": known + """SELECT id_no, part, string_agg(media_id, ',' ORDER BY media_id) AS items,
            string_agg(CAST(views AS VARCHAR), ',' ORDER BY media_id) AS views FROM (
              SELECT *, CAST('0x' || substr(md5(media_id), 1, 8) AS BIGINT)
                % CAST(ceil(count(*) OVER (PARTITION BY id_no) / 8) AS BIGINT) AS part FROM
              (SELECT id_no, media_id, count(*) AS views FROM known GROUP BY 1, 2)) GROUP BY 1, 2""",
        "require_modalities": _with("meta", "inv") + f"SELECT * FROM meta WHERE {complete}",
        "pending_items": _with("meta", "inv")
        + "SELECT media_id AS id FROM meta EXCEPT SELECT id FROM inv WHERE modality = 'vision'",
        "build_index": _with("log", "clean") + index.format(c="id_no", t="clean"),
        "encode_ids": _with("meta") + """SELECT user_id, coalesce(idx, -1) AS track_id, count FROM
            (SELECT o_custkey AS user_id, CAST(l_partkey AS VARCHAR) AS track_id, count(*) AS count
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) LEFT JOIN
            (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM
             (SELECT DISTINCT substr(media_id, 2) AS id FROM meta)) ON track_id = id""",
        "label_of_category": _with("meta") + """SELECT media_id, CAST(CASE channel_category WHEN 'ARTIS' THEN 1
            WHEN 'DRAMA' THEN 2 WHEN 'ENTER' THEN 3 WHEN 'NEWS' THEN 4 WHEN 'SPORT' THEN 5 ELSE 0 END AS BIGINT)
            AS label FROM meta""",
        "daily_scores": train_scores.format(ds=", CAST(ds AS VARCHAR) AS ds", day=", ds", score=_r("sum(score)", "score")),
        "pair_scores": train_scores.format(ds="", day="", score=_r("sum(score)", "score")),
        "index_interactions": _with(*CLEAN, day="SELECT id_no, media_id, ds, sum(score) AS score FROM known GROUP BY 1, 2, 3")
        + f"""SELECT id_no, media_id, {_text('ds')}, {_r('score')},
            dense_rank() OVER (ORDER BY id_no) - 1 AS "userId", dense_rank() OVER (ORDER BY media_id) - 1 AS "mediaId"
            FROM day""",
        "item_texts": f"SELECT doc_id, {TEXT} AS text FROM documents",
        "clean_texts": f"SELECT doc_id, {_cleaned(TEXT)} AS text FROM documents",
        "normalized_vectors": vec + _elements(
            "(SELECT id, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS vec FROM v)",
            "vec", "id"),
        "cosine_neighbours": f"""SELECT a.vec_id, {_r('list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))', 'cosine')}
            FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        "assemble_modalities": feats + _elements(
            f"""(SELECT item_id, vision || audio || lyrics || genres || cf AS vec FROM ({wide})
            WHERE item_id IN (SELECT id FROM asked))""", "vec", "item_id"),
        "assemble_modalities_counts": feats + """SELECT count(*) AS asked, count(v.id) AS complete,
            count(*) - count(v.id) AS dropped FROM (SELECT DISTINCT id FROM asked) a LEFT JOIN v ON v.id = a.id""",
        "concat_modality_vectors": feats + _elements(
            f"(SELECT item_id, vision || audio || genres AS vec FROM ({wide}))", "vec", "item_id"),
        "lookup_vectors": feats + _elements("(SELECT id, vec FROM v WHERE id IN (SELECT id FROM asked))", "vec", "id"),
        "lookup_vectors_counts": feats + """SELECT count(v.id) AS found, count(*) - count(v.id) AS missing
            FROM (SELECT DISTINCT id FROM asked) a LEFT JOIN v ON v.id = a.id""",
        "select_targets": feats + _elements(
            "(SELECT * FROM f WHERE item_id IN (SELECT id FROM asked))", "vec", "item_id", "modality"),
        "select_targets_counts": feats + """SELECT count(*) FILTER (item_id IN (SELECT id FROM asked)) AS kept,
            count(*) FILTER (item_id NOT IN (SELECT id FROM asked)) AS rejected FROM f""",
        "pool_segments": f"""WITH s AS ({SEQ}) SELECT item_id, CAST(floor(pos / 10) AS BIGINT) AS segment,
            CAST(dim AS BIGINT) AS dim, {_r('avg(x)', 'val')} FROM s GROUP BY 1, 2, 3""",
        "pool_mean": f"""WITH s AS ({SEQ}) SELECT item_id, CAST(dim AS BIGINT) AS dim, {_r('avg(x)', 'val')}
            FROM s GROUP BY 1, 2""",
        "frame_signal": f"WITH v AS ({VEC}), sig AS (SELECT id, list_transform(range(1, 33), lambda i: (vec[i] + vec[i + 32]) / 2) AS x FROM v) "
        + _elements(f"({frames.format(n=4)})", "s", "id", "frame"),
        "frame_signal_rows": f"WITH v AS ({VEC}), sig AS (SELECT id, vec AS x FROM v) "
        + _elements(f"({frames.format(n=7)})", "s", "id", "frame"),
        "clip_power": f"SELECT user_id AS clip_id, {_r('avg(value * value)', 'power')}, count(*) AS n FROM events GROUP BY 1",
        "clip_power_normalized": f"""SELECT user_id AS clip_id, event_id,
            {_r('value * sqrt(1.0 / avg(value * value) OVER (PARTITION BY user_id))', 'x')} FROM events""",
        "array_power": vec + _elements(
            f"""(SELECT id, {_r('p', 'power')}, list_transform(vec, lambda x: x * sqrt(2.0 / p)) AS vec
            FROM (SELECT *, list_dot_product(vec, vec) / len(vec) AS p FROM v))""", "vec", "id", "power"),
        "topk_similar": vec + f"""SELECT id_no, media_id, {_r('rating')}, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY id_no ORDER BY rating DESC, media_id) AS rank FROM (
              SELECT a.id AS id_no, b.id AS media_id, round(list_cosine_similarity(a.vec, b.vec), 12) AS rating
              FROM v a CROSS JOIN v b)) WHERE rank <= {K}""",
        "per_user_metrics": _with(*CLEAN, **PREDICTION, **_metrics("known", "pred"))
        + f"SELECT id_no, hits, n_rel, {_r('precision')}, {_r('recall')}, {_r('ndcg')}, {_r('map')} FROM per_user",
        "ranking_metrics": _with(*CLEAN, **PREDICTION, **_metrics("known", "pred")) + _averaged(),
        "ranking_metrics_copies": _with(*CLEAN, **PREDICTION, **_metrics(
            "known", "pred", dedupe=False, denominator=f"least(n_rel, {K})")) + _averaged(),
        "evaluate_slices": _with(*CLEAN, **_day_split("known"), all_slices=SLICES["slices"],
                                 slices="SELECT * FROM all_slices WHERE starts_with(slice, 'test/')", **slice_pred,
                                 **_metrics("slices", "pred", "slice")) + none_missing.format(_averaged("slice")),
        "evaluate_all_slices": _with(*CLEAN, **_day_split("known"), **SLICES, **slice_pred,
                                     **_metrics("slices", "pred", "slice")) + none_missing.format(_averaged("slice")),
        "evaluate_content": _with(*CLEAN, **_day_split("known"), all_slices=SLICES["slices"],
                                  slices="SELECT * FROM all_slices WHERE starts_with(slice, 'test/')", **content,
                                  **_metrics("slices", "pred", "slice"))
        + f"SELECT *, CAST(0 AS BIGINT) AS users_missing FROM ({_averaged('slice')}) JOIN gone USING (slice)",
        "als_residual": _with(*CLEAN, **_day_split("known"), day=day) + """SELECT row_number() OVER (ORDER BY id_no) - 1 AS id,
            count(*) AS n, TRUE AS solved FROM day GROUP BY id_no""",
        "als_splits": SPLIT_LOG + """SELECT DISTINCT split, 'user' AS side, id_no AS id, CAST(128 AS BIGINT) AS n FROM splitlog
            UNION ALL SELECT DISTINCT split, 'item', media_id, 128 FROM splitlog""",
        "als_counts": _with("meta", tracks=tracks) + """SELECT count(*) AS read, CAST(0 AS BIGINT) AS no_user, count(*) FILTER (NOT listed) AS no_item,
            count(*) FILTER (NOT counted) AS no_rating, count(*) FILTER (listed AND counted) AS used FROM tracks""",
        "als_explicit_residual": _with("meta", tracks=tracks)
        + "SELECT l_orderkey AS id, count(*) AS n, TRUE AS solved FROM tracks WHERE listed AND counted GROUP BY 1",
        "als_saved": """SELECT DISTINCT 'user' AS side, o_custkey AS id, CAST(128 AS BIGINT) AS n, TRUE AS same FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            UNION ALL SELECT 'item', row_number() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) - 1, 128, TRUE FROM
              (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
        "factor_table": known + "SELECT DISTINCT media_id AS id, CAST(128 AS BIGINT) AS n FROM known",
        "fit_fusion_ridge": "SELECT CAST(0 AS BIGINT) AS epoch, 0.0::DOUBLE AS train_loss, 0.0::DOUBLE AS valid_loss",
        "score_fusion": feats + f"""SELECT item_id, CAST(dim - 1 AS BIGINT) AS dim, {_r('val', 'planted')}, TRUE AS recovered FROM
            (SELECT id AS item_id, unnest(cf) AS val, generate_subscripts(cf, 1) AS dim FROM p)""",
        "ablation_exact": "SELECT * FROM (VALUES ('v', FALSE), ('a', FALSE), ('t', FALSE), ('va', FALSE), ('vt', FALSE), ('at', FALSE), ('vat', TRUE)) x(modality, exact)",
        "source_log": log + f"SELECT {_log_cols(SHOWN_USER)} FROM log",
        "source_counts": """SELECT l_orderkey AS user_id, 't' || l_partkey AS track_id,
            CASE WHEN l_linenumber = 7 THEN -1 ELSE CAST(trunc(l_quantity) AS BIGINT) END AS count FROM lineitem""",
        "source_counts_malformed": "SELECT count(*) AS rows, count(*) FILTER (l_linenumber = 7) AS malformed FROM lineitem",
        "source_wide_features": vec + _elements("(SELECT id AS item_id, 'vision' AS modality, vec FROM v)", "vec", "item_id", "modality"),
        "source_catalog": f"""SELECT 'm' || p_partkey AS item_id,
            {_r('CASE WHEN p_size = 13 THEN -1.0 ELSE p_retailprice END', 'min')}, p_name AS title FROM part""",
        "source_id_map": "SELECT 'm' || p_partkey AS id, CAST(p_size AS BIGINT) AS idx FROM part",
        "source_slice": _with(*CLEAN, **_day_split("known"), **SLICES)
        + f"SELECT slice, media_id, id_no, {_r('score')} FROM slices",
        "source_slice_array": SPLIT_LOG + f"SELECT media_id, id_no, {_r('score')} FROM splitlog",
        "source_split_ids": """SELECT 'm' || p_partkey AS id,
            CASE WHEN p_size > 40 THEN 'TEST' WHEN p_size > 30 THEN 'VALID' ELSE 'TRAIN' END AS split FROM part""",
        "sink_stage": "SELECT * FROM supplier",
        "sink_manifest": SPLIT_LOG + f"SELECT * FROM ({manifest})",
        "sink_vectors": feats + _elements("f", "vec", "item_id", "modality"),
        "sink_factors": vec + _elements("v", "vec", "id"),
        "sink_results": _with(*CLEAN, **PREDICTION, **_metrics("known", "pred")) + _averaged(),
        "source_file_inventory": "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS nation FROM customer",
        "parsed_floats": f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, dim, {_r('CAST(val AS FLOAT)', 'val')} FROM (
            SELECT *, CAST(0 AS BIGINT) AS dim, trunc(l_extendedprice) AS val FROM lineitem
            UNION ALL SELECT *, 1, l_discount FROM lineitem)""",
    }
