"""Quality rules whose cutoffs come from the data: quantile sketches per language and source.

The sketch is a histogram over whole numbers with seven significant bits per bucket (relative error below 1/64). Buckets do not depend on
the data, so two sketches merge by adding counts: per-task sketches into one per (language, source), those into one per language, those into
one of everything. A group's cutoffs are Tukey fences of its own sketch; a group with few documents takes those of its language, a language with
few documents those of everything. Everything is a DataFrame expression; no rows leave the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.llm.exprs import let, positions, words
from runsight.session import materialize

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
FENCE = 3
MIN_GROUP = 200
#: Metric: whether values below the lower fence fail as well as those above the upper one.
METRICS = {"word_length_pct": True, "symbols_pm": False, "dup_lines_pm": False, "repeat_words_pm": False}
#: Least spread that a group is given: most groups hold hardly any symbols or repeats, and one repeated line of ten is no sign of junk.
LEAST_SPREAD = {"word_length_pct": 10, "symbols_pm": 10, "dup_lines_pm": 100, "repeat_words_pm": 100}


def _repeated(w: Column) -> Column:
    """Words that lie in a three-word window which occurs at least twice in the text."""
    windows = F.transform(positions(1, F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def marked(s: Column) -> Column:
        same = lambda j, k: F.element_at(s, j)["h"] == F.element_at(s, k)["h"]
        again = F.filter(positions(1, F.size(s)), lambda j: F.when(j > 1, same(j, j - 1)).otherwise(False) | F.when(j < F.size(s), same(j, j + 1)).otherwise(False))
        spots = F.flatten(F.transform(again, lambda j: let(F.element_at(s, j)["i"], lambda i: F.array(i, i + 1, i + 2))))
        return F.size(F.array_distinct(spots))

    def count(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(ordered, marked))

    return let(windows, count)


def base_counts(text: Column) -> dict[str, Column]:
    """Counts over the whole text, null taken as empty: words, their code points, symbols, repeated lines, words in repeated windows, lines."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    by_word = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words")),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {"by_word": by_word, "by_line": by_line, "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")}


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source, the counts of ``base_counts``."""
    return docs.select("doc_id", "lang", "source", *[c.alias(k) for k, c in base_counts(F.col("text")).items()]).select(
        "doc_id", "lang", "source", "by_word.*", "by_line.*", "n_symbols"
    )


def base_failed() -> Column:
    """The fixed part: too few words, or most words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """Whole-number metrics of a measured document; those without words or lines have 0."""
    share = lambda top, scale, bottom: F.when(F.col(bottom) > 0, F.expr(f"({top} * {scale}) div {bottom}")).otherwise(F.lit(0).cast("long"))
    return {
        "word_length_pct": share("word_chars", 100, "n_words"),
        "symbols_pm": share("n_symbols", 1000, "word_chars"),
        "dup_lines_pm": share("n_dup_lines", 1000, "n_lines"),
        "repeat_words_pm": share("n_repeat_words", 1000, "n_words"),
    }


def bucket(value: Column) -> Column:
    """Smallest number of the sketch bucket that ``value`` (0 or more) falls into: its seven leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    size = F.pow(F.lit(2.0), shift).cast("long")
    return value - F.pmod(value, size)


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bucket, n) of all documents; counts are combined in each task before the shuffle."""
    cells = F.array(*[F.struct(F.lit(name).alias("metric"), bucket(value).alias("bucket")) for name, value in metrics().items()])
    return measured.select(*keys, F.explode(cells).alias("cell")).groupBy(*keys, "cell.metric", "cell.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of coarser groups: counts of equal buckets added up."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, docs, q1, q3): the bucket in which a quarter and three quarters of the documents are reached. A group has at most a few
    thousand buckets however many documents it holds."""
    group = Window.partitionBy(*keys, "metric")
    counted = sketches.withColumn("docs", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
    return counted.groupBy(*keys, "metric").agg(
        F.max("docs").alias("docs"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs") * 3, F.col("bucket"))).alias("q3"),
    )


def fences(quarts: DataFrame, keys: list[str], fence: int = FENCE) -> DataFrame:
    """One row per group: docs and, for each metric, the lowest and highest value that passes.

    The spread counts as 1/16 of the upper quartile and as ``LEAST_SPREAD`` at least, so that a metric that is the same nearly everywhere does not
    reject the first value beside it.
    """
    least = reduce(lambda rest, name: F.when(F.col("metric") == name, F.lit(LEAST_SPREAD[name]).cast("long")).otherwise(rest), METRICS, F.lit(0).cast("long"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.expr("q3 div 16"), least)
    limits = quarts.select(*keys, "metric", "docs", (F.col("q1") - fence * spread).alias("low"), (F.col("q3") + fence * spread).alias("high"))
    columns = [F.max("docs").alias("docs")]
    for name in METRICS:
        columns += [F.max(F.when(F.col("metric") == name, F.col(side))).alias(f"{name}_{side}") for side in ("low", "high")]
    return limits.groupBy(*keys).agg(*columns)


def adaptive_limits(measured: DataFrame, fence: int = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, limits): for every (language, source) the fences of the finest group that has ``min_group`` documents."""
    fine = materialize(sketch(measured, ["lang", "source"]))
    own = fences(quartiles(fine, ["lang", "source"]), ["lang", "source"], fence)
    by_lang = fences(quartiles(merge(fine, ["lang"]), ["lang"]), ["lang"], fence)
    total = fences(quartiles(merge(fine, []), []), [], fence)
    names = [f"{name}_{side}" for name in METRICS for side in ("low", "high")]
    row = lambda a: F.struct(*[F.col(f"{a}.{n}").alias(n) for n in names])
    pick = F.when(F.col("o.docs") >= min_group, row("o")).when(F.col("l.docs") >= min_group, row("l")).otherwise(row("t"))
    return (
        own.alias("o")
        .join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")))
        .join(F.broadcast(total.alias("t")), F.lit(True))  # one row
        .select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), pick.alias("limits"))
    )


def quality_rules(docs: DataFrame, fence: int = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts of every document and whether it is kept: not ``base_failed`` and every metric inside the fences of its language and source.

    Null text counts as empty, null language or source is a group of its own, repeated rows are judged and counted one by one, an empty table gives no
    rows. Only doc_id, text, lang and source are read, so extra columns play no part.
    """
    measured = materialize(measure(docs))
    limits = adaptive_limits(measured, fence, min_group)
    inside = reduce(
        lambda a, b: a & b,
        [(value <= F.col(f"limits.{name}_high")) & ((value >= F.col(f"limits.{name}_low")) if METRICS[name] else F.lit(True)) for name, value in metrics().items()],
    )
    joined = measured.alias("m").join(limits.alias("g"), F.col("m.lang").eqNullSafe(F.col("g.lang")) & F.col("m.source").eqNullSafe(F.col("g.source")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept")
    )
