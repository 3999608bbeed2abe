"""Personal data: fixed patterns, and identifiers that the fixed patterns miss, found by the words around known ones.

1. Base: four fixed regular expressions give spans (kind, start, end) in code points.
2. Seeds and patterns: each base span is a seed entity. The two and the three words before it, and one and two words before with the one behind it, are its lexical patterns.
   Every other word that holds a digit or an at sign is a candidate with patterns of its own.
3. Graph: patterns that at least ``min_seeds`` different seeds and a candidate share are kept. An edge says how often a pattern stood around an entity. How often
   a pattern stands around any word at all is counted over the whole corpus, so a pattern of ordinary prose scores near 0.
4. Scores: a pattern's score per kind is the share of its occurrences that hold entities of that kind; an entity's score is the noisy-or over its
   patterns. Both are computed in turn, so that entities found by sure patterns support further patterns.
5. Candidates whose score reaches ``accept``, and that look like the kind at all, become spans.

Only DataFrame expressions are used. Texts are cut by regular expressions that need no backtracking beyond a word, so that long texts without spaces stay linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.llm.exprs import fresh, let, positions, words
from runsight.plans.sizing import broadcast_if_small
from runsight.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. Lookbehinds, \G (end of the match before) and possessive repeats do not change what matches; they keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word with a digit or an at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Contexts are read from so many code points on either side of an entity.
REACH = 80
#: So many patterns are looked up in place.
FEW_PATTERNS = 5_000
PATTERN_NAMES = ("left2", "left", "around", "both")
SPAN = "array<struct<kind:string,start:bigint,end:bigint,surface:string>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _valid(kind: str, surface: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(surface, r"\."), lambda part: let(F.ltrim(part, F.lit("0")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))))
    if kind == "card":
        return let(F.translate(surface, " -", ""), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    return F.regexp_count(surface, F.lit("[0-9]")).between(8, 15)


def matches(text: Column, pattern: str, kind: Column) -> Column:
    """All matches with their places: the pieces between the matches give the starts."""

    def place(x: Column) -> Column:
        def step(seen: Column, i: Column) -> Column:
            start = seen["at"] + F.length(F.element_at(x["pieces"], i))
            end = start + F.length(F.element_at(x["found"], i))
            span = F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), F.element_at(x["found"], i).alias("surface"))
            return F.struct(end.alias("at"), F.array_append(seen["spans"], span).alias("spans"))

        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(positions(1, F.size(x["found"])), begin, step)["spans"]

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(F.rlike(text, F.lit(pattern)), let(both, place)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind in order of their start; matches that fail the kind's check are dropped."""
    return F.filter(matches(text, PATTERNS[kind], F.lit(kind)), lambda s: _valid(kind, s["surface"]))


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text (null as empty), base: all base spans by kind, then start."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.concat(*[base_spans(F.col("text"), kind) for kind in KINDS]).alias("base"))


def _contexts(text: Column, span: Column) -> Column:
    """Hashes of the four lexical patterns around a span, null where the text has too few words there."""

    before = F.lower(F.substr(text, F.greatest(span["start"] - REACH + 1, F.lit(1)), F.least(span["start"], F.lit(REACH))))
    after = F.lower(F.substr(text, span["end"] + 1, F.lit(REACH)))

    def keys(w: Column) -> Column:
        b, a = w.getItem(0), w.getItem(1)
        return F.struct(
            F.when(F.size(b) >= 2, F.xxhash64(F.lit("left2"), F.element_at(b, -2), F.element_at(b, -1))).alias("left2"),
            F.when(F.size(b) >= 3, F.xxhash64(F.lit("left"), F.element_at(b, -3), F.element_at(b, -2), F.element_at(b, -1))).alias("left"),
            F.when((F.size(b) >= 1) & (F.size(a) >= 1), F.xxhash64(F.lit("around"), F.element_at(b, -1), F.element_at(a, 1))).alias("around"),
            F.when((F.size(b) >= 2) & (F.size(a) >= 1), F.xxhash64(F.lit("both"), F.element_at(b, -2), F.element_at(b, -1), F.element_at(a, 1))).alias("both"),
        )

    return let(F.array(words(before), words(after)), keys)


def _word_contexts(text: Column) -> Column:
    """Pattern hashes around every word of a text."""

    def around(w: Column) -> Column:
        at = lambda name, less, *places: F.transform(positions(1, F.size(w) - less), lambda i: F.xxhash64(F.lit(name), *[F.element_at(w, i + k) for k in places]))
        return F.concat(at("left2", 2, 0, 1), at("left", 3, 0, 1, 2), at("around", 2, 0, 2), at("both", 3, 0, 1, 3))

    return let(words(F.lower(text)), around)


def _fits(kind: str, surface: Column) -> Column:
    """What a candidate must look like to be taken for the kind."""
    digits = F.regexp_count(surface, F.lit("[0-9]"))
    if kind == "email":
        return F.rlike(surface, F.lit(r"@|[\[(]at[\])]"))
    if kind == "ip":
        return (digits >= 4) & F.rlike(surface, F.lit(r"^[^A-Za-z]*[0-9][.:][0-9]+[.:][0-9]"))
    if kind == "card":
        return digits.between(12, 19) & ~F.rlike(surface, F.lit("[A-Za-z]"))
    return digits.between(7, 15) & ~F.rlike(surface, F.lit("[A-Za-z@]"))


def entities(found: DataFrame) -> DataFrame:
    """Every base span and every candidate word outside of them: place, surface, kind (null for candidates) and its patterns."""
    outside = F.filter(
        matches(F.col("text"), CANDIDATE, F.lit(None).cast("string")),
        lambda c: (F.length(c["surface"]) >= 6)
        & ((F.regexp_count(c["surface"], F.lit("[0-9]")) >= 4) | F.contains(c["surface"], F.lit("@")))
        & ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])),
    )
    spans = found.select("doc_id", "text_key", "text", F.explode(F.concat("base", outside)).alias("s"))
    return spans.select(
        "doc_id", "text_key", "s.*", F.xxhash64(F.lower("s.surface"), "s.kind").alias("entity"), _contexts(F.col("text"), F.col("s")).alias("c")
    ).select("doc_id", "text_key", "kind", "start", "end", "surface", "entity", *[F.col(f"c.{p}").alias(p) for p in PATTERN_NAMES])


def scored_entities(edges: DataFrame, totals: DataFrame, rounds: int) -> DataFrame:
    """(entity, one score per kind) of the candidates after ``rounds`` turns over the pattern-entity graph.

    ``edges``: pattern, entity, kind of seeds, n. ``totals``: pattern, occurrences around any word. Scores are written to the shared folder in each turn, so
    lineage does not grow.
    """
    none = [F.lit(0.0).alias(k) for k in KINDS]
    scores = edges.where("kind IS NULL").select("entity", *none).distinct()
    for _ in range(rounds):
        known = edges.join(scores, "entity", "left")
        held = [F.sum(F.col("n") * F.when(F.col("kind") == k, 1.0).otherwise(F.coalesce(k, F.lit(0.0)))).alias(k) for k in KINDS]
        sums = known.groupBy("pattern").agg(F.sum("n").alias("seen"), *held)
        share = [(F.col(k) / (F.greatest("seen", F.coalesce("total", F.lit(0))) + 1)).alias(k) for k in KINDS]
        patterns = sums.join(totals, "pattern", "left").select("pattern", *share)
        scores = materialize(
            edges.where("kind IS NULL").join(patterns, "pattern").groupBy("entity").agg(*[(1 - F.exp(F.sum(F.log1p(-F.col(k))))).alias(k) for k in KINDS])
        )
    return scores


def _totals(corpus: DataFrame, strong: DataFrame) -> DataFrame:
    """How often each pattern of ``strong`` (a written table) stands around any word. A few are a set of numbers that rows are tested against before they are counted in their task;
    only more than ``FEW_PATTERNS`` take a join, with a row per occurrence."""
    few = [row["pattern"] for row in strong.limit(FEW_PATTERNS + 1).collect()]
    held = corpus.where(F.col("pattern").isin(few)) if len(few) <= FEW_PATTERNS else corpus.join(broadcast_if_small(strong, stored=True), "pattern")
    return materialize(held.groupBy("pattern").agg(F.count("*").alias("total")))


def discovered(docs: DataFrame, found: DataFrame, min_seeds: int = 3, rounds: int = 3, accept: float = 0.8) -> DataFrame:
    """(doc_id, text_key, added): spans beyond the base of the documents that have any."""
    spots = materialize(entities(found))
    around = spots.select("entity", "kind", F.explode(F.array(*PATTERN_NAMES)).alias("pattern")).where("pattern IS NOT NULL")
    edges = around.groupBy("pattern", "entity", "kind").agg(F.count("*").alias("n"))
    # Only patterns around candidates bear on a score: those that common words share with seeds alone, by chance, need not be counted in the corpus.
    kept = (F.count("kind") >= min_seeds) & (F.count("*") > F.count("kind"))
    strong = edges.groupBy("pattern").agg(kept.alias("kept")).where("kept").select("pattern")
    strong = materialize(strong)  # eight bytes a row: the row limit of the broadcast is a limit of bytes
    edges = materialize(edges.join(strong, "pattern"))
    corpus = docs.select(F.explode(_word_contexts(F.coalesce("text", F.lit("")))).alias("pattern"))
    scores = scored_entities(edges, _totals(corpus, strong), rounds)
    best = F.greatest(*KINDS)
    fitting = F.coalesce(*[F.when((F.col(k) == best) & _fits(k, F.col("surface")), F.lit(k)) for k in KINDS])
    chosen = spots.where("kind IS NULL").drop("kind").join(scores.where(best >= accept), "entity").withColumn("kind", fitting).where("kind IS NOT NULL")
    span = F.struct("kind", "start", "end", "surface").alias("span")
    return chosen.select("doc_id", "text_key", span).distinct().groupBy("doc_id", "text_key").agg(F.collect_list("span").alias("added"))


def find_pii(docs: DataFrame, min_seeds: int = 3, rounds: int = 3, accept: float = 0.8) -> DataFrame:
    """doc_id, text_key, base and added spans (kind, start, end, surface) of every document.

    Null or empty texts have none. Rows with the same doc_id are searched one by one, each by its own text. Only doc_id and text are read. Identical
    entities share their evidence, and counts are combined per task before each shuffle, so copies of one document make neither
    larger groups nor further rows.
    """
    found = with_base(docs)
    added = discovered(docs, found, min_seeds, rounds, accept).select(F.col("doc_id").alias("held_id"), F.col("text_key").alias("held_key"), "added")
    same = F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("text_key") == F.col("held_key"))
    spans = found.select("doc_id", "text_key", "base").join(added, same, "left")
    return spans.select("doc_id", "text_key", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans per kind, their digest, and all spans by kind, then start."""

    def own(spans: Column, kind: str) -> Column:
        return F.filter(spans, lambda s: s["kind"] == kind)

    def of(kind: str) -> Column:
        return F.array_sort(F.transform(own(F.concat("base", "added"), kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    counts = [F.size(own(F.col("base"), kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    every = F.concat(*[of(kind) for kind in KINDS])
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the one that starts first names the place, and all are covered."""

    def step(done: Column, s: Column) -> Column:
        apart = s["start"] >= done["at"]
        gap = F.substr(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        out = F.when(apart, F.concat(done["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.aggregate(ordered, begin, step), rest))


def mask_documents(docs: DataFrame, min_seeds: int = 3, rounds: int = 3, accept: float = 0.8) -> DataFrame:
    """``docs`` with personal data in text masked; all columns and rows stay, null texts stay null."""
    held, key, more = (fresh(docs, name) for name in ("held_id", "held_key", "added"))
    added = discovered(docs, with_base(docs), min_seeds, rounds, accept).select(F.col("doc_id").alias(held), F.col("text_key").alias(key), F.col("added").alias(more))
    same = F.col("doc_id").eqNullSafe(F.col(held)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key))
    base = F.concat(*[base_spans(F.col("text"), kind) for kind in KINDS])
    spans = F.concat(base, F.coalesce(more, F.array().cast(SPAN)))
    joined = docs.join(broadcast_if_small(added, 2_000), same, "left")
    masked = F.when(F.col("text").isNotNull(), mask(F.col("text"), spans))
    return joined.select(*[masked.alias(c) if c == "text" else F.col(c) for c in docs.columns])
