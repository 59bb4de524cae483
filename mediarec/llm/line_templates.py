"""Line deduplication with a log-template tree, in DataFrame functions only.

Every line with at least `min_tokens` words is parsed at fixed depth: words
holding a digit become a wildcard; the token count and the first `depth` tokens
choose a leaf. A leaf holds any number of templates. Inside it lines are
compared by the tokens after the leading ones, cut into at most `parts`
consecutive parts (single tokens in lines up to that length): two lines are alike if they
agree in at least `similar` of the parts. Where at most d parts may differ, the
parts are dealt into d + 1 sections, and lines that are alike agree in a whole
section. So lines meet in the buckets of their sections only; the part met most
often at a position is the bucket's template there, the lines alike to it are its
members, and a line of several templates goes with the one that most texts
have. Positions in which members differ are the template's variable fields. A line
without such a template is one of its own and recurs only unchanged; lines with
too few tokens for a part to differ always are.

A template recurs if it occurs in `min_docs` different texts, or in
`passage_docs` if it is at least `passage_tokens` long. Copies of a whole text
count as one text: they are the business of document deduplication. A recurring
template stays in the first text that has it (smallest id) and is dropped from
all others.

Only hashes move between tasks; a line found in a third of all texts is counted
by the map tasks first, and a template with very many variants is joined with
them by parts. Texts are shuffled once, with the hashes to drop.

Defined results: null text stays null and blank lines stay as they are; a null
id counts as the largest; rows that repeat an id share its decisions; a text
whose lines all go becomes empty; other columns are left alone, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mediarec.llm.common import fresh
from mediarec.operators.skew import HOT_ROWS, hot_key_join
from mediarec.operators.staging import stage

# A word with a digit in it, without backtracking.
_VARIABLE = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9]*+[0-9][^\\x20\\x09-\\x0D]*"
_ODD_GAPS = ("  ", "\t", "\r", "\x0b", "\x0c")
WILDCARD = "<*>"


@dataclass(frozen=True)
class TemplateConfig:
    depth: int = 3            # leading tokens that choose the leaf, besides the token count
    parts: int = 16
    similar: float = 0.7
    min_tokens: int = 3       # shorter lines are never dropped
    min_docs: int = 3
    passage_tokens: int = 50
    passage_docs: int = 2


def _even(text: Column) -> Column:
    """Single spaces between words. Most texts have no others, so a search decides before the replacement."""
    odd = F.lit(False)
    for gap in _ODD_GAPS:
        odd = odd | F.contains(text, F.lit(gap))
    return F.when(odd, F.regexp_replace(text, "[\\x20\\x09\\x0B-\\x0D]+", " ")).otherwise(text)


def _masked(even: Column) -> Column:
    """Words with a digit replaced by the wildcard."""
    return F.when(even.rlike("[0-9]"), F.regexp_replace(even, _VARIABLE, WILDCARD)).otherwise(even)


def _lines(masked: Column) -> Column:
    return F.transform(F.split(masked, "\n", -1), lambda line: F.trim(line))


def masked_lines(text: Column) -> Column:
    """Lines of a text with single spaces and variable words replaced."""
    return _lines(_masked(_even(text)))


def line_id(line: Column) -> Column:
    return F.xxhash64(line)


def _parts(tokens: Column, n: Column, config: TemplateConfig) -> Column:
    """Hashes of at most `parts` consecutive pieces of the tokens after the leading ones; empty if there are none."""
    m, first, k = n - config.depth, config.depth + 1, config.parts
    # A line of up to `parts` such tokens has a piece for each. The pieces' bounds in a longer one are written out: a lambda is interpreted.
    cut = [F.floor(m * (i / k)).cast("int") if not k & (k - 1) else F.floor(i * m / F.lit(k)).cast("int") for i in range(k)] + [m]
    return F.when(m <= 0, F.array().cast("array<int>")).when(
        m <= k, F.transform(F.slice(tokens, first, F.greatest(m, F.lit(0))), lambda token: F.hash(token))).otherwise(
            F.array(*[F.hash(F.slice(tokens, cut[i] + first, cut[i + 1] - cut[i])) for i in range(k)]))


def parsed(docs: DataFrame, config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """One row per countable line: doc, body (hash of the whole text), line, leaf, n, parts."""
    # Step by step, so that each is evaluated once.
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"),
                       F.xxhash64("text").alias("body"), _even(F.col("text")).alias("even"))
    base = base.select("doc", "body", _masked(F.col("even")).alias("masked")).select(
        "doc", "body", F.explode(_lines(F.col("masked"))).alias("shape"))
    # A filter on the tokens' number would split every line a second time.
    long_ = base.where(F.col("shape").rlike(f"^(?:[^ ]+ ){{{config.min_tokens - 1}}}[^ ]"))
    sized = long_.withColumn("tokens", F.split("shape", " ", -1)).withColumn("n", F.size("tokens"))
    return sized.select("doc", "body", line_id(F.col("shape")).alias("line"),
                        F.xxhash64("n", F.slice("tokens", 1, config.depth)).alias("leaf"), "n",
                        _parts(F.col("tokens"), F.col("n"), config).alias("parts"))


def _may_differ(config: TemplateConfig) -> Column:
    """Parts in which a line may differ from its template."""
    k = F.size("parts")
    return (k - F.ceil(F.lit(config.similar) * k - F.lit(1e-9))).cast("int")


def _sections(config: TemplateConfig) -> Column:
    """Hashes of the line's leaf and the parts of each section, one section more than parts may differ."""
    k, s = F.size("parts"), F.col("sections")
    return F.transform(F.sequence(F.lit(0), s - 1), lambda g: F.xxhash64("leaf", g, F.slice(
        "parts", F.floor(g * k / s).cast("int") + 1, (F.floor((g + 1) * k / s) - F.floor(g * k / s)).cast("int"))))


def templates(lines: DataFrame, variants: DataFrame, config: TemplateConfig, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(line, template): the template of every distinct line that has one with two variants or more; staged."""
    # A leaf with one variant, or lines in which no part may differ, have nothing to generalise.
    open_ = lines.where(_may_differ(config) > 0).select("leaf", "line", "parts")
    mixed = variants.groupBy("leaf").agg(F.count(F.lit(1)).alias("v")).where(F.col("v") > 1).select("leaf")
    shapes = (open_.groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("parts").alias("parts"))
              .join(mixed, "leaf", "left_semi").join(variants.select("line", "texts"), "line"))
    placed = stage(shapes.withColumn("sections", _may_differ(config) + 1).select(
        "line", "leaf", "parts", "texts", F.explode(_sections(config)).alias("bucket")), "line-sections")
    crowded = stage(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1), "line-buckets")
    met = stage(hot_key_join(placed, crowded, "bucket", "rows", hot_rows).drop("rows"), "line-candidates")
    constants = (met.select("bucket", "texts", F.posexplode("parts").alias("at", "part"))
                 .groupBy("bucket", "at", "part").agg(F.sum("texts").alias("weight"))
                 .groupBy("bucket", "at").agg(F.max(F.struct("weight", "part")).alias("top"))
                 # At most `parts` rows per bucket.
                 .groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("at", F.col("top.part").alias("part")))).alias("at_part")))
    shape = stage(constants.select("bucket", F.transform("at_part", lambda t: t["part"]).alias("shape")).join(crowded, "bucket"), "line-shapes")
    same = F.aggregate(F.zip_with("parts", "shape", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    member = stage(hot_key_join(met, shape, "bucket", "rows", hot_rows).where(F.size("parts") - same <= _may_differ(config)).select(
        "line", "texts", "shape", F.xxhash64("leaf", "shape").alias("template")).distinct(), "line-members")
    weight = member.groupBy("template").agg(F.sum("texts").alias("weight"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    best = hot_key_join(member, stage(weight, "line-weights"), "template", "rows", hot_rows).groupBy("line").agg(
        F.max(F.struct("weight", "shape", "template")).alias("best"))
    return stage(best.select("line", F.col("best.template").alias("template")), "line-templates")


def recurring(lines: DataFrame, config: TemplateConfig = TemplateConfig(), hot_rows: int = HOT_ROWS) -> DataFrame:
    """(line, doc, body): each masked line of a recurring template, with the first text that has the template.

    A text counts once for a template, however many variants of it it has.
    """
    texts = lines.groupBy("line", "body").agg(F.min("doc").alias("doc"), F.first("leaf").alias("leaf"), F.first("n").alias("n"))
    variants = stage(texts.groupBy("line").agg(
        F.count(F.lit(1)).alias("texts"), F.min(F.struct("doc", "body")).alias("first"),
        F.first("leaf").alias("leaf"), F.first("n").alias("n")), "line-variants")
    named = templates(lines, variants, config, hot_rows)
    enough = F.when(F.col("n") >= config.passage_tokens, config.passage_docs).otherwise(config.min_docs)
    alone = variants.join(named.select("line"), "line", "left_anti").where(F.col("texts") >= enough).select(
        "line", F.col("first.doc").alias("doc"), F.col("first.body").alias("body"))
    bodies = lines.join(named, "line").groupBy("template", "body").agg(F.min("doc").alias("doc"), F.max("n").alias("n"))
    totals = bodies.groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("doc", "body")).alias("first"), F.max("n").alias("n")).where(
        F.col("texts") >= enough).select("template", F.col("first.doc").alias("doc"), F.col("first.body").alias("body"))
    return stage(alone.unionByName(named.join(totals, "template").select("line", "doc", "body")), "line-recurring")


def marked(docs: DataFrame, config: TemplateConfig = TemplateConfig(), out: str = "gone") -> DataFrame:
    """`docs` with an array column `out`: the ids of the lines to drop from the row's text, null if there are none."""
    lines = stage(parsed(docs.select("doc_id", "text"), config), "lines")
    first = recurring(lines, config)
    drops = (lines.select("line", F.col("doc").alias("d"), F.col("body").alias("t")).join(first, "line")
             .where(F.col("t") != F.col("body")).groupBy("d").agg(F.collect_set("line").alias(out)))
    (key,) = fresh(docs, "line_key")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)))
    return keyed.join(drops.withColumnRenamed("d", key), key, "left").select(*docs.columns, out)


def kept_lines(text: Column, gone: Column) -> Column:
    """The lines of `text` that are not to go, as an array; null if none is to go."""
    # `gone` holds ids of lines long enough to count only.
    pairs = F.arrays_zip(F.split(text, "\n", -1).alias("line"), masked_lines(text).alias("shape"))
    left = F.filter(pairs, lambda p: ~F.array_contains(gone, line_id(p["shape"])))
    return F.when(gone.isNotNull(), F.transform(left, lambda p: p["line"]))


def drop_recurring(docs: DataFrame, config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """`docs` with the lines of recurring templates dropped from `text`; `n_chars`, if there, is brought up to date."""
    (gone,) = fresh(docs, "gone")
    found = marked(docs, config, gone)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept_lines(F.col("text"), F.col(gone)), "\n"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)
