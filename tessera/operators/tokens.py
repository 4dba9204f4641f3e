"""Tokenisation, vocabulary and decoding.

The built-in tokenizer is a regex word tokenizer (special tokens atomic,
then words, then single symbols) with a frequency-ranked vocabulary, so its
output is checkable in SQL.  A real subword tokenizer plugs in through
``tokenize_with`` (an Arrow-batched pandas function).

Id lookup goes by two-level dictionaries (``operators.dictionary``): a slice
of texts is numbered by its own distinct tokens, only those are looked up, and
the numbers are mapped back to ids inside each row.  The lookup is split by
frequency: the ``hot_size`` most frequent tokens (a bounded, broadcast table)
are resolved map-side, the long tail goes through a shuffle join.  Both are
exact; nothing is capped, and each text's regex runs once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import constants as K
from tessera.functions.text import PY_WS
from tessera.operators.dictionary import decode, encode
from tessera.operators.ranking import global_rank

# FIXED VALUES: the word-tokenizer pattern (special tokens first, then
# letter/digit/underscore runs, then any other single non-space character).
TOKEN_RE = (r"<\|[a-z_]+\|>|\[@BOS@\]|[\p{L}\p{N}_]+|[^\p{L}\p{N}_"
            + PY_WS[1:-1] + "]")

# FIXED VALUES: ids of the special tokens of the built-in tokenizer.
UNK_ID = 0
SPECIAL_IDS = {
    K.BOS: K.BOS_ID,
    K.START_OF_TURN: 3,
    K.END_OF_TURN: 4,
    K.IMAGE_SOFT_TOKEN: K.IMAGE_TOKEN_ID,
    K.START_OF_IMAGE: K.IMAGE_START_ID,
    K.END_OF_IMAGE: K.IMAGE_END_ID,
}
HOT_SIZE = 1 << 16


def special_id(tok: Column) -> Column:
    out = F.lit(None).cast("int")
    for t, i in SPECIAL_IDS.items():
        out = F.when(tok == F.lit(t), F.lit(i)).otherwise(out)
    return out


def word_tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(TOKEN_RE), 0)


def build_vocab(df: DataFrame, text_col: str = "text", materialize: bool = False) -> DataFrame:
    """Token -> id by descending frequency, ties by token, ids after the
    reserved block (T2).  Ids that collide with the image start/end ids are
    skipped.  Counting is a partial + final aggregation; ranking is the
    range-partitioned rank over (count, token), never one task.

    The vocabulary is an artifact that every tokenisation reads: with
    ``materialize`` (for callers that look ids up more than once) it is
    written once (reliable ``checkpoint`` into ``spark.checkpoint.dir``), so
    the corpus is scanned once and the lineage is cut.
    """
    from tessera.session import checkpoint_dir
    counts = df.select(F.explode(word_tokens(text_col)).alias("t")).groupBy("t") \
        .agg(F.count(F.lit(1)).alias("c"))
    ranked = global_rank(counts, [F.col("c").desc(), F.col("t")], [], rank_col="_r")
    base = F.col("_r") + F.lit(K.RESERVED_IDS - 1)
    tid = F.when(base >= F.lit(K.IMAGE_START_ID), base + 2).otherwise(base)
    vocab = ranked.select("t", tid.cast("bigint").alias("id"), "c")
    if materialize:
        checkpoint_dir(df.sparkSession)
        return vocab.checkpoint()
    return vocab


def _looked_up(entries: DataFrame, vocab: DataFrame, on: str, get: str, hot_size: int) -> DataFrame:
    """``entries`` (…, value) with ``get`` of the vocabulary row whose ``on``
    equals the value, or null: hot rows broadcast, the tail shuffled."""
    v = vocab.select(F.col("t"), F.col("id").cast("int").alias("id"))
    v = v.select(F.col(on).alias("_on"), F.col(get).alias(get), (F.col("id") < K.RESERVED_IDS + hot_size).alias("_hot"))
    hot = v.where("_hot").drop("_hot")                       # at most hot_size rows
    tail = v.where(~F.col("_hot")).drop("_hot")
    first = entries.join(F.broadcast(hot), entries["value"] == hot["_on"], "left")
    done = first.where(F.col("_on").isNotNull()).drop("_on")
    rest = first.where(F.col("_on").isNull()).select(*entries.columns)
    return done.unionByName(rest.join(tail, rest["value"] == tail["_on"], "left").drop("_on"))


def tokenize(df: DataFrame, key: str, parts: list[str], vocab: DataFrame,
             out: str = "input_ids", n_first: str = "n_prompt", hot_size: int = HOT_SIZE,
             max_length: int | None = None) -> DataFrame:
    """Tokenise each of ``parts`` separately and concatenate (T1): prompt and
    answer are never tokenised as one string.  Adds ``out`` (ARRAY<INT>) and
    ``n_first`` (tokens of the first part).  Rows are kept whatever their
    ``key`` is.

    With ``max_length`` the result is right-truncated (T7): each part is cut
    to its first ``max_length`` tokens before anything leaves the row, so
    tokens past the cap reach no dictionary however long the text is;
    ``n_first`` still counts every token of the first part (the regex runs
    over the whole text).
    """
    toks = df.select("*", *[F.coalesce(word_tokens(p), F.array().cast("array<string>")).alias(f"_t{i}")
                            for i, p in enumerate(parts)])
    cut = F.concat(*[F.col(f"_t{i}") if max_length is None else F.slice(f"_t{i}", 1, max_length)
                     for i in range(len(parts))])
    toks = toks.select(*df.columns, F.size("_t0").alias(n_first),
                       (cut if max_length is None else F.slice(cut, 1, max_length)).alias("_tokens"))
    rows, entries = encode(toks, "_tokens")
    known = entries.select("slice", "number", special_id(F.col("value")).alias("id")).where("id is not null")
    plain = _looked_up(entries.where(special_id(F.col("value")).isNull()), vocab, "t", "id", hot_size)
    ids = known.unionByName(plain.select("slice", "number", F.coalesce("id", F.lit(UNK_ID)).alias("id")))
    found = decode(rows, ids.withColumnRenamed("id", out), out)
    return found.select(*df.columns, out, n_first)


def decode_ids(df: DataFrame, key: str, ids_col: str, vocab: DataFrame, out: str = "text",
               skip_below: int = K.RESERVED_IDS, hot_size: int = HOT_SIZE) -> DataFrame:
    """Ids back to text (T9): special and reserved ids dropped, tokens joined
    with single spaces (the word tokenizer keeps no whitespace).  Rows are kept
    whatever their ``key`` is."""
    plain = F.filter(ids_col, lambda i: (i >= skip_below) & ~i.isin(K.IMAGE_START_ID, K.IMAGE_END_ID))
    rows, entries = encode(df.select("*", plain.alias("_plain")), "_plain")
    found = _looked_up(entries, vocab, "id", "t", hot_size).select(
        "slice", "number", F.coalesce("t", F.lit("<unk>")).alias("_texts"))
    texts = decode(rows, found, "_texts")
    return texts.select(*df.columns, F.array_join("_texts", " ").alias(out))


def tokenize_with(df: DataFrame, text_col: str, encode: Callable[[list[str]], list[list[int]]],
                  out: str = "input_ids") -> DataFrame:
    """Plug-in tokenizer (U1): ``encode`` maps a batch of strings to id lists.
    Runs as an Arrow-batched pandas function; the tokenizer object is built
    once per Python worker by the caller's closure."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _enc(s: pd.Series) -> pd.Series:
        return pd.Series(encode(s.fillna("").tolist()))
    return df.withColumn(out, _enc(F.col(text_col)))


def constant_ids(spark, vocab: DataFrame, texts: list[str]) -> list[list[int]]:
    """Ids of constant strings (template pieces, a system prompt): the same
    Java regex tokenises them in one one-row job, and only their distinct
    tokens (a bounded handful) are looked up, in one more."""
    arr = F.array(*[F.lit(t) for t in texts])
    toks = spark.range(1).select(F.transform(arr, lambda x: word_tokens(x)).alias("t")).first()["t"]
    plain = sorted({t for ts in toks for t in ts if t not in SPECIAL_IDS})
    found = {r["t"]: int(r["id"]) for r in vocab.where(F.col("t").isin(plain)).select("t", "id").collect()} \
        if plain else {}
    return [[SPECIAL_IDS[t] if t in SPECIAL_IDS else found.get(t, UNK_ID) for t in ts] for ts in toks]


class PromptTemplate:
    """Id pieces of the image chat prompt, so ids are assembled by array
    concatenation instead of tokenising the rendered string: the image
    block (hundreds of placeholders per image) is ``array_repeat``, and only
    the user text goes through tokenisation.  Token boundaries at every
    junction are fixed (specials are atomic and a newline or a special
    separates template from text), so the result equals tokenising the
    rendered prompt."""

    def __init__(self, spark, vocab: DataFrame, system: str | None = None):
        nl = "\n"
        head = K.BOS
        if system:
            head += K.START_OF_TURN + "system" + nl + system + K.END_OF_TURN
        head += K.START_OF_TURN + "user" + nl + K.START_OF_IMAGE
        self.head, self.mid, self.tail, self.answer_end = constant_ids(
            spark, vocab, [head, K.END_OF_IMAGE + nl, K.END_OF_TURN + K.START_OF_TURN + "assistant" + nl,
                           K.END_OF_TURN])

    @staticmethod
    def _arr(ids: list[int]) -> Column:
        return F.array(*[F.lit(int(i)) for i in ids]).cast("array<int>")

    def prompt_ids(self, user_ids, n_img) -> Column:
        u = F.col(user_ids) if isinstance(user_ids, str) else user_ids
        n = F.col(n_img) if isinstance(n_img, str) else n_img
        return F.concat(self._arr(self.head), F.array_repeat(F.lit(K.IMAGE_TOKEN_ID), n.cast("int")),
                        self._arr(self.mid), u, self._arr(self.tail))

    def answer_ids(self, text_ids) -> Column:
        t = F.col(text_ids) if isinstance(text_ids, str) else text_ids
        return F.concat(t, self._arr(self.answer_end))
