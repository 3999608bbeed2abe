"""Imputing, scaling, encoding, chat text, tokens, overlap, forecasts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.operators import baselines, chat, forecast, models, prep
from runsight.operators.registry import Domain
from runsight.plans.running import hot_keys
from runsight.queries import query, r, table
from runsight.queries.inputs import WITH_GAPS, with_gaps

# --- imputing, scaling, encoding ------------------------------------------------------------------------

_FILLED = """m AS (SELECT median(p_size) AS ms, median(p_retailprice) AS mp FROM gaps),
f AS (SELECT p_partkey, coalesce(p_size, ms) AS p_size, coalesce(p_retailprice, mp) AS p_retailprice, p_brand, p_type FROM gaps, m)"""
_MODES = """mb AS (SELECT p_brand AS v FROM gaps WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
mt AS (SELECT p_type AS v FROM gaps WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


@query(f"WITH {WITH_GAPS}, {_FILLED} SELECT p_partkey, p_size, round(p_retailprice, 4) AS p_retailprice FROM f")
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    out = prep.impute_median(with_gaps(spark, d), ["p_size", "p_retailprice"])
    return out.select("p_partkey", "p_size", r("p_retailprice", 4).alias("p_retailprice"))


@query("SELECT round(median(l_extendedprice), 4) AS price, round(median(l_quantity), 4) AS quantity, round(median(l_discount), 4) AS discount FROM lineitem")
def exact_medians(spark: SparkSession, d: str) -> DataFrame:
    columns = ["l_extendedprice", "l_quantity", "l_discount"]
    medians = prep.column_medians(table(spark, d, "lineitem"), columns)
    return spark.createDataFrame([tuple(round(medians[c], 4) for c in columns)], "price double, quantity double, discount double")


@query(f"""WITH {WITH_GAPS}, {_MODES} SELECT p_partkey, coalesce(p_brand, (SELECT v FROM mb)) AS p_brand, coalesce(p_type, (SELECT v FROM mt)) AS p_type FROM gaps""")
def impute_mode(spark: SparkSession, d: str) -> DataFrame:
    return prep.impute_mode(with_gaps(spark, d), ["p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type")


@query("""SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal, 0.0::DOUBLE AS one FROM customer""")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    out = prep.standardize(table(spark, d, "customer").withColumn("one", F.lit(1.0)), ["c_acctbal", "one"])
    return out.select("c_custkey", r("c_acctbal").alias("c_acctbal"), "one")


@query("""WITH ids AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS place FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 5000))
SELECT c_custkey, coalesce(CAST(place AS INT), -1) AS place, (SELECT CAST(count(*) AS INT) FROM ids) AS width FROM customer LEFT JOIN ids USING (c_mktsegment)""")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    out = prep.one_hot(customer, "c_mktsegment", train=customer.where(F.col("c_acctbal") > 5000))
    bits = vector_to_array("c_mktsegment_hot")
    return out.select("c_custkey", (F.array_position(bits, 1.0) - 1).cast("int").alias("place"), F.size(bits).alias("width"))


@query("""WITH ids AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS label_id FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c_custkey, c_mktsegment, label_id FROM customer JOIN ids USING (c_mktsegment)""")
def encode_labels(spark: SparkSession, d: str) -> DataFrame:
    return prep.encode_labels(table(spark, d, "customer"), "c_mktsegment").select("c_custkey", "c_mktsegment", "label_id")


@query("SELECT c_name AS label, count(*) AS n, row_number() OVER (ORDER BY c_name) - 1 AS label_id FROM customer GROUP BY 1")
def label_index(spark: SparkSession, d: str) -> DataFrame:
    return prep.label_index(table(spark, d, "customer"), "c_name")


@query(f"""WITH {WITH_GAPS}, {_FILLED}, {_MODES}, s AS (SELECT avg(p_size) AS a1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS a2, stddev_pop(p_retailprice) AS s2 FROM f),
bi AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) OVER () AS nb FROM (SELECT DISTINCT p_brand FROM gaps WHERE p_brand IS NOT NULL)),
ti AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS j FROM (SELECT DISTINCT p_type FROM gaps WHERE p_type IS NOT NULL))
SELECT p_partkey, round((p_size - a1) / s1, 6) AS size, round((p_retailprice - a2) / s2, 6) AS price, CAST(2 + i AS INT) AS brand_place, CAST(2 + nb + j AS INT) AS type_place
FROM f, s, mb, mt, bi, ti WHERE bi.p_brand = coalesce(f.p_brand, mb.v) AND ti.p_type = coalesce(f.p_type, mt.v)""")
def preprocessor(spark: SparkSession, d: str) -> DataFrame:
    rows = with_gaps(spark, d)
    features = vector_to_array(F.col("features"))
    out = models.build_preprocessor(rows, ["p_partkey"]).fit(rows).transform(rows).select("p_partkey", features.alias("v"))
    brands = rows.where(F.col("p_brand").isNotNull()).select("p_brand").distinct().count()
    place = lambda start, n: (F.array_position(F.slice("v", start + 1, n), 1.0) - 1 + start).cast("int")
    return out.select(
        "p_partkey", r(F.col("v")[0]).alias("size"), r(F.col("v")[1]).alias("price"), place(2, brands).alias("brand_place"),
        place(2 + brands, 1_000_000).alias("type_place"),
    )


@query(f"""WITH {WITH_GAPS}, {_FILLED}, s AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS s FROM f)
SELECT p_partkey, round((p_size - a) / s, 6) AS p_size FROM f, s""")
def domain_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps registered for a domain, run in order."""
    domain = Domain("parts")
    domain.step(lambda df: prep.impute_median(df, ["p_size", "p_retailprice"]), "impute")
    domain.step(lambda df: prep.standardize(df, ["p_size"]), "scale")
    return domain.run(with_gaps(spark, d)).select("p_partkey", r("p_size").alias("p_size"))


# --- chat and tokens ---------------------------------------------------------------------------------------

_PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS output FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
_CHAT = "'<|im_start|>user' || chr(10) || coalesce(instruction, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || coalesce(output, '') || '<|im_end|>' || chr(10)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return chat.instruction_pairs(table(spark, d, "conversations"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, {_CHAT} AS text FROM pairs")
def format_as_chat(spark: SparkSession, d: str) -> DataFrame:
    return chat.format_as_chat(_pairs(spark, d)).select("conv_id", "turn", "text")


@query("""SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(count(*) AS INT) AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY 1""")
def format_conversations(spark: SparkSession, d: str) -> DataFrame:
    return chat.format_conversations(table(spark, d, "conversations"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, {_CHAT} AS text FROM pairs")
def format_messages(spark: SparkSession, d: str) -> DataFrame:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    pairs = _pairs(spark, d).withColumn("messages", F.array(message("user", "instruction"), message("assistant", "output")))
    return chat.format_messages(pairs).select("conv_id", "turn", "text")


@query(f"""WITH {_PAIRS}, k AS (SELECT *, conv_id * 1000 + turn AS id FROM pairs)
SELECT id, {_CHAT} AS text, instruction, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':42')) <= floor(count(*) OVER () * 0.1) AS is_eval FROM k""")
def format_dataset(spark: SparkSession, d: str) -> DataFrame:
    keyed = _pairs(spark, d).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return chat.format_dataset(keyed, "id").select("id", "text", "instruction", "is_eval")


@query(f"WITH {_PAIRS} SELECT count(*) - CAST(floor(count(*) * 0.1) AS BIGINT) AS train, CAST(floor(count(*) * 0.1) AS BIGINT) AS eval, count(*) AS num_samples FROM pairs")
def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    keyed = _pairs(spark, d).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return chat.split_counts(chat.format_dataset(keyed, "id"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, {_CHAT} AS text FROM pairs")
def apply_chat_template(spark: SparkSession, d: str) -> DataFrame:
    """The same through a template function that is loaded once per worker."""

    def load():
        return lambda messages: "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages)

    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    pairs = _pairs(spark, d).withColumn("messages", F.array(message("user", "instruction"), message("assistant", "output")))
    return chat.apply_chat_template(pairs, load).select("conv_id", "turn", "text")


_WORDS = r"SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents"


@query(f"SELECT token, count(*) AS n FROM ({_WORDS}) WHERE token <> '' GROUP BY 1")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return chat.token_counts(table(spark, d, "documents"))


@query(f"SELECT count(DISTINCT token) AS vocab_size FROM ({_WORDS}) WHERE token <> ''")
def vocab_size(spark: SparkSession, d: str) -> DataFrame:
    return chat.vocab_size(table(spark, d, "documents"))


@query(f"""WITH v AS (SELECT count(DISTINCT token) AS n FROM ({_WORDS}) WHERE token <> '')
SELECT 'random_guess' AS name, round(ln(n), 6) AS score, 0.0::DOUBLE AS std FROM v UNION ALL SELECT 'untrained_model', round(0.8 * ln(n), 6), 0.0 FROM v""")
def baseline_loss_vocab(spark: SparkSession, d: str) -> DataFrame:
    out = baselines.baseline_loss_vocab_of(chat.vocab_size(table(spark, d, "documents")))
    return out.select("name", r("score").alias("score"), "std")


@query(f"""WITH v AS (SELECT count(DISTINCT token) AS n FROM ({_WORDS}) WHERE token <> '')
SELECT 'random_guess' AS name, n::DOUBLE AS score, 0.0::DOUBLE AS std FROM v UNION ALL SELECT 'untrained_model', round(0.8 * n, 6), 0.0 FROM v""")
def baseline_perplexity_vocab(spark: SparkSession, d: str) -> DataFrame:
    out = baselines.baseline_loss_vocab_of(chat.vocab_size(table(spark, d, "documents")), "perplexity")
    return out.select("name", r("score").alias("score"), "std")


_TOKEN_IDS = f"""WITH c AS (SELECT token, count(*) AS n FROM ({_WORDS}) WHERE token <> '' GROUP BY 1),
v AS (SELECT token, 1 + row_number() OVER (ORDER BY n DESC, token) AS id FROM c QUALIFY id <= 501),
t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))  AS token,
  generate_subscripts(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), 1) AS i FROM documents),
e AS (SELECT doc_id, string_agg(CAST(coalesce(id, 1) AS VARCHAR), ' ' ORDER BY i) AS s, count(*) AS k FROM t LEFT JOIN v USING (token) WHERE i <= 64 GROUP BY 1)
SELECT doc_id, trim(coalesce(s, '') || repeat(' 0', CAST(64 - coalesce(k, 0) AS INT))) AS ids, CAST(coalesce(k, 0) AS INT) AS used FROM documents LEFT JOIN e USING (doc_id)"""


def _shown(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"),
    )


@query(_TOKEN_IDS)
def tokenize_truncate(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    return _shown(chat.word_ids(documents, chat.vocabulary(documents, size=500), max_length=64))


@query(_TOKEN_IDS)
def tokenize_by_hook(spark: SparkSession, d: str) -> DataFrame:
    """The same words by a tokenizer that workers load."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    return _shown(chat.tokenize_truncate(documents, chat.word_tokenizer(chat.vocabulary(documents, size=500)), max_length=64))


_NGRAMS = r"""tok AS (SELECT conv_id, turn, side, t, i, lead(t) OVER (PARTITION BY conv_id, turn, side ORDER BY i) AS t2 FROM (
  SELECT conv_id, turn, 'p' AS side, unnest(regexp_extract_all(lower(output), '[a-z0-9]+')) AS t, generate_subscripts(regexp_extract_all(lower(output), '[a-z0-9]+'), 1) AS i FROM pairs
  UNION ALL SELECT conv_id, turn, 'r', unnest(regexp_extract_all(lower(instruction), '[a-z0-9]+')), generate_subscripts(regexp_extract_all(lower(instruction), '[a-z0-9]+'), 1) FROM pairs)),
g AS (SELECT conv_id, turn, 1 AS k, t AS gram, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM tok GROUP BY ALL
  UNION ALL SELECT conv_id, turn, 2, t || ' ' || t2, count(*) FILTER (side = 'p'), count(*) FILTER (side = 'r') FROM tok WHERE t2 IS NOT NULL GROUP BY ALL),
f AS (SELECT conv_id, turn, k, 2.0 * sum(least(p, r)) / sum(p + r) AS f FROM g GROUP BY ALL)"""


@query(f"""WITH {_PAIRS}, {_NGRAMS} SELECT conv_id, turn, round(coalesce(max(f) FILTER (k = 1), 0), 6) AS rouge1, round(coalesce(max(f) FILTER (k = 2), 0), 6) AS rouge2
FROM pairs LEFT JOIN f USING (conv_id, turn) GROUP BY ALL""")
def rouge_rows(spark: SparkSession, d: str) -> DataFrame:
    return chat.rouge_rows(_pairs(spark, d), "output", "instruction").select("conv_id", "turn", r("rouge1").alias("rouge1"), r("rouge2").alias("rouge2"))


@query(f"""WITH {_PAIRS}, {_NGRAMS} SELECT round((SELECT sum(f) FROM f WHERE k = 1) / count(*), 6) AS rouge1, round((SELECT sum(f) FROM f WHERE k = 2) / count(*), 6) AS rouge2 FROM pairs""")
def rouge_scores(spark: SparkSession, d: str) -> DataFrame:
    return chat.rouge_scores(_pairs(spark, d), "output", "instruction").select(r("rouge1").alias("rouge1"), r("rouge2").alias("rouge2"))


# The table of common subsequences, a row of it per step of the recursion.
@query(f"""WITH RECURSIVE {_PAIRS}, tok AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(output, '')), '[a-z0-9]+') AS a, regexp_extract_all(lower(coalesce(instruction, '')), '[a-z0-9]+') AS b FROM pairs),
w AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(range(0, len(a) + 1), lambda x: 0::BIGINT) AS l FROM tok
  UNION ALL SELECT conv_id, turn, a, b, i + 1, list_transform(range(1, len(a) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND a[k - 1] = b[i + 1] THEN l[k - 1] + 1 ELSE l[k] END)))
  FROM w WHERE i < len(b))
SELECT conv_id, turn, round(CASE WHEN l[len(a) + 1] > 0 THEN 2.0 * l[len(a) + 1] / (len(a) + len(b)) ELSE 0 END, 6) AS "rougeL" FROM w WHERE i = len(b)""")
def rouge_longest_subsequence(spark: SparkSession, d: str) -> DataFrame:
    """Longest common subsequences are not a SQL matter; tests compare them with a plain table."""
    return chat.rouge_rows(_pairs(spark, d), "output", "instruction").select("conv_id", "turn", r("rougeL").alias("rougeL"))


# --- forecasts ------------------------------------------------------------------------------------------------


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    quarter = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), quarter.alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


_QUARTERS = """q AS (SELECT o_orderpriority AS series_id, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"""
_LAG = "lag(value, {n}) OVER (PARTITION BY series_id ORDER BY period)"


@query(f"WITH {_QUARTERS} SELECT series_id, period, value, {_LAG.format(n=1)} AS forecast FROM q")
def baseline_naive(spark: SparkSession, d: str) -> DataFrame:
    return forecast.baseline_naive(_quarters(spark, d)).select("series_id", "period", "value", "forecast")


@query(f"WITH {_QUARTERS} SELECT series_id, period, value, {_LAG.format(n=4)} AS forecast FROM q")
def baseline_seasonal_naive(spark: SparkSession, d: str) -> DataFrame:
    return forecast.baseline_seasonal_naive(_quarters(spark, d)).select("series_id", "period", "value", "forecast")


@query(f"""WITH {_QUARTERS}, f AS (SELECT series_id, value, {_LAG.format(n=4)} AS forecast FROM q)
SELECT series_id, round(avg(abs(value - forecast) / value), 6) AS mape, count(*) AS n FROM f WHERE forecast IS NOT NULL GROUP BY 1""")
def forecast_mape(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_mape(forecast.baseline_seasonal_naive(_quarters(spark, d))).withColumn("mape", r("mape"))


@query("""SELECT user_id % 3 AS series_id, ts AS period, value, row_number() OVER w AS position, lag(value, 7) OVER w AS week_before FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY ts)""")
def lag_in_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Three long series as hot keys, in ranges of 300 rows at most: the last seven rows of each are sent on."""
    series = table(spark, d, "events").select((F.col("user_id") % 3).alias("series_id"), F.col("ts").alias("period"), "value")
    return forecast.lagged(series, 7, "week_before", hot_keys(series, ["series_id"], 100), chunk_rows=300)


@query(f"""WITH {_QUARTERS}, p AS (SELECT series_id, period, row_number() OVER (PARTITION BY series_id ORDER BY period) AS position, count(*) OVER (PARTITION BY series_id) AS n FROM q),
b AS (SELECT *, n // 6 AS b FROM p), t AS (SELECT *, CASE WHEN position > n - 5 * b THEN CAST((position - (n - 5 * b) - 1) // b + 1 AS INT) END AS test_fold FROM b)
SELECT series_id, period, position, test_fold, CASE WHEN coalesce(test_fold, 0) < 5 THEN coalesce(test_fold, 0) + 1 END AS trains_from FROM t""")
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return forecast.walk_forward(_quarters(spark, d)).select("series_id", "period", "position", "test_fold", "trains_from")


@query("""SELECT event_id % 2 AS conv_id, CAST(0 AS BIGINT) AS part, CAST(count(*) AS INT) AS n_turns,
  string_agg('<|im_start|>' || event_type || chr(10) || user_id || '<|im_end|>' || chr(10), '' ORDER BY event_id) AS text FROM events GROUP BY 1""")
def format_long_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Two conversations of thousands of turns."""
    turns = table(spark, d, "events").select(
        (F.col("event_id") % 2).alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("role"), F.col("user_id").cast("string").alias("text")
    )
    return chat.format_conversations(turns)
