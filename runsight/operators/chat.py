"""Text and chat preparation, tokens and vocabularies, text overlap scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.functions.rouge import overlap_f1, pairs, rouge_longest, tokens
from runsight.operators.prep import SEED, split_train_eval

TURN = "<|im_start|>%s\n%s<|im_end|>\n"  # default template of one message: role, content
WORD = r"[^\p{L}\p{N}]+"  # tokens are runs of letters and digits
PAD, UNKNOWN, FIRST_ID = 0, 1, 2


def render(role: Column, content: Column, template: str = TURN) -> Column:
    return F.format_string(template, role, F.coalesce(content, F.lit("")))


def format_as_chat(df: DataFrame, instruction: str = "instruction", output: str = "output", template: str = TURN) -> DataFrame:
    """Add ``text``: the pair as a user and an assistant message; a missing side is empty."""
    return df.withColumn(
        "text", F.concat(render(F.lit("user"), F.col(instruction), template), render(F.lit("assistant"), F.col(output), template))
    )


def format_messages(df: DataFrame, messages: str = "messages", template: str = TURN) -> DataFrame:
    """Add ``text`` from an array of (role, content) messages."""
    return df.withColumn("text", F.array_join(F.transform(messages, lambda m: render(m["role"], m["content"], template)), ""))


def format_conversations(turns: DataFrame, template: str = TURN, part_turns: int | None = None) -> DataFrame:
    """Turns (conv_id, turn, role, text) to texts in turn order: (conv_id, part, n_turns, text).

    A conversation is one text, whatever its length, unless ``part_turns`` asks for parts: then a longer one goes on in
    part 1, 2, and so on.
    """
    part = F.floor(F.col("turn") / part_turns) if part_turns else F.lit(0).cast("long")
    rendered = turns.select("conv_id", "turn", part.alias("part"), render(F.col("role"), F.col("text"), template).alias("t"))
    grouped = rendered.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("turns"))
    return grouped.select("conv_id", "part", F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["t"]), "").alias("text"))


def instruction_pairs(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn right after them: (conv_id, turn, instruction, output)."""
    user = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    answer = turns.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return user.join(answer, ["conv_id", "turn"])


def format_dataset(df: DataFrame, key: str, eval_fraction: float = 0.1, seed: int = SEED, template: str = TURN) -> DataFrame:
    """Records with their chat ``text`` and ``is_eval``; the original columns stay."""
    return split_train_eval(format_as_chat(df, template=template), key, eval_fraction, seed)


def split_counts(formatted: DataFrame) -> DataFrame:
    return formatted.agg(
        F.count_if(~F.col("is_eval")).alias("train"), F.count_if(F.col("is_eval")).alias("eval"), F.count(F.lit(1)).alias("num_samples")
    )


# --- tokens ------------------------------------------------------------------------------------------


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    tokens = df.select(F.explode(F.split(F.lower(F.col(text)), WORD)).alias("token")).where(F.col("token") != "")
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocab_size(df: DataFrame, text: str = "text") -> DataFrame:
    """Number of different tokens."""
    return token_counts(df, text).agg(F.count(F.lit(1)).alias("vocab_size"))


def vocabulary(df: DataFrame, text: str = "text", size: int = 32_000) -> DataFrame:
    """The ``size`` most frequent tokens with ids from 2 on; 0 pads and 1 stands for the rest."""
    order = (F.desc("n"), "token")
    top = token_counts(df, text).orderBy(*order).limit(size)
    # The window holds no more than the wanted tokens.
    return top.select("token", (F.row_number().over(Window.orderBy(*order)) + FIRST_ID - 1).alias("id"))


def word_tokenizer(df_vocabulary: DataFrame) -> Callable[[], Callable[[str], list[int]]]:
    """Loader of a word-level tokenizer over a vocabulary table, for ``tokenize_truncate``."""

    ids = {r["token"]: r["id"] for r in df_vocabulary.collect()}
    sent = df_vocabulary.sparkSession.sparkContext.broadcast(ids)

    def load() -> Callable[[str], list[int]]:
        table, pattern = sent.value, regex.compile(r"[\p{L}\p{N}]+")
        return lambda text: [table.get(w, UNKNOWN) for w in pattern.findall(text.lower())]

    return load


def word_ids(df: DataFrame, df_vocabulary: DataFrame, text: str = "text", max_length: int = 512) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask`` of exactly ``max_length`` places by a word-level vocabulary (token, id), without leaving the JVM and without a shuffle.

    The vocabulary, which is as large as its ``size`` says, is one row: an array of buckets by hash, of which a word looks at one. Only as many words are cut off a text as are kept.
    """
    held = df_vocabulary.select("token", F.col("id").cast("int").alias("id"))
    buckets = 1 << max(1, held.count() - 1).bit_length()
    entries: list[list] = [[] for _ in range(buckets)]
    for row in held.select("token", "id", F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("bucket")).collect():  # at most ``size`` rows
        entries[row["bucket"]].append((row["token"], row["id"]))
    table = df.sparkSession.createDataFrame([(entries,)], "_table array<array<struct<token: string, id: int>>>")
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD, max_length + 2), lambda w: w != "")
    own = lambda w: F.filter(F.get("_table", F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")), lambda e: e["token"] == w)
    found = F.transform(F.slice(words, 1, max_length), lambda w: F.coalesce(F.get(own(w), F.lit(0))["id"], F.lit(UNKNOWN)))
    return _padded(df.join(F.broadcast(table)).withColumn("_ids", found), df.columns, max_length)


def _padded(ids: DataFrame, columns: Sequence[str], max_length: int) -> DataFrame:
    gap = F.lit(max_length) - F.size("_ids")
    one = lambda v: F.lit(v).cast("int")
    return ids.select(
        *columns,
        F.concat("_ids", F.array_repeat(one(PAD), gap)).alias("input_ids"),
        F.concat(F.transform("_ids", lambda _: one(1)), F.array_repeat(one(0), gap)).alias("attention_mask"),
    )


def tokenize_truncate(df: DataFrame, load: Callable[[], Callable[[str], Sequence[int]]], text: str = "text", max_length: int = 512) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask`` of exactly ``max_length`` places.

    ``load`` returns a text-to-ids function and is called once per worker: any tokenizer fits in.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for batch in batches:
            yield batch.map(lambda t: list(tokenizer(t or "")[:max_length]))

    return _padded(df.withColumn("_ids", encode(F.col(text))), df.columns, max_length)


def apply_chat_template(df: DataFrame, load: Callable[[], Callable[[list[dict]], str]], messages: str = "messages") -> DataFrame:
    """Add ``text`` by a model's own chat template. ``load`` is called once per worker."""

    @F.pandas_udf("string")
    def fill(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        template = load()
        for batch in batches:
            yield batch.map(lambda rows: template([dict(m) for m in rows]))

    return df.withColumn("text", fill(F.col(messages)))


# --- overlap scores -----------------------------------------------------------------------------------


def rouge_rows(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Add rouge1, rouge2 and rougeL of each row."""
    words = df.select("*", tokens(F.col(prediction)).alias("_p"), tokens(F.col(reference)).alias("_r"))
    p, r = F.col("_p"), F.col("_r")
    return words.select(*df.columns, overlap_f1(p, r).alias("rouge1"), overlap_f1(pairs(p), pairs(r)).alias("rouge2"), rouge_longest(p, r).alias("rougeL"))


def rouge_scores(df: DataFrame, prediction: str = "prediction", reference: str = "reference", by: Sequence[str] = ()) -> DataFrame:
    """Mean overlap over rows."""
    rows = rouge_rows(df, prediction, reference)
    return rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rougeL")])
