"""The mixed training stream (E1): tokenised vision-language samples in
order, each followed with probability r/(1-r) by a tokenised text-only
example from the fixed pool (M1, M2, P9, T1, T5-T7, T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import arrays as AR
from tessera.functions import prompts as PR
from tessera.operators import mixture as MX
from tessera.operators.tokens import TOKEN_RE, tokenize, word_tokens
from tessera.plans.assembly import P_TEXT, POOL_SQL, SEED, sql_hash
from tessera.plans.registry import query
from tessera.plans.samples import (TOKENIZED_SQL, _special_case, _tokens_sql, corpus_vocab,
                                   tokenized_samples_df, vocab_sql)

MAX_LEN = 512


def pool_samples(spark, vocab, max_length: int = MAX_LEN):
    """The pool's closed text examples, tokenised once (five rows): labels
    masked up to the first ``assistant\\n``, found by re-tokenising the
    prefix (T6), then truncated (T7)."""
    pool = MX.pool_frame(spark, K.TEXT_PROMPT_POOL)
    ps = pool.select("pool_idx", PR.render_text_sample("question", "answer").alias("sample"))
    ps = ps.withColumn("n_prefix", F.size(word_tokens(PR.supervision_prefix("sample"))))
    t = tokenize(ps, "pool_idx", ["sample"], vocab, "ids", "_n")
    return t.select("pool_idx", AR.truncate("ids", max_length).alias("input_ids"),
                    AR.truncate(AR.mask_labels("ids", "n_prefix"), max_length).alias("labels"))


TRAINING_SQL = f"""
with tok as ({TOKENIZED_SQL}),
r as (select sample_id, row_number() over (order by sample_id) as vl_rank from tok),
pool as ({POOL_SQL}),
vocab as ({vocab_sql()}),
ps as (select pool_idx, '[@BOS@]<|start_of_turn|>user' || chr(10) || question
          || '<|end_of_turn|><|start_of_turn|>assistant' || chr(10) || answer || '<|end_of_turn|>' as sample from pool),
ptk as ({_tokens_sql("ps", "pool_idx", ["sample"])}),
pti as (select k, pos, coalesce({_special_case('tok')}, vocab.id, 0) as id from ptk left join vocab on ptk.tok = vocab.t),
pagg as (select k as pool_idx, list(id order by pos) as ids from pti group by k),
pn as (select pool_idx, len(regexp_extract_all(substring(sample, 1, instr(sample, 'assistant' || chr(10)) + 9),
          '{TOKEN_RE}')) as n_prefix from ps),
ptext as (select pagg.pool_idx, list_slice(ids, 1, {MAX_LEN}) as t_ids,
            list_slice(list_transform(ids, lambda x, i: case when i <= pn.n_prefix then -100 else x end), 1, {MAX_LEN}) as t_labels
          from pagg join pn on pagg.pool_idx = pn.pool_idx)
select tok.sample_id, r.vl_rank, false as is_text, cast(null as bigint) as pool_idx, tok.n_tokens,
       tok.n_supervised, tok.ids
from tok join r on tok.sample_id = r.sample_id
union all
select r.sample_id, r.vl_rank, true as is_text, ptext.pool_idx, len(ptext.t_ids) as n_tokens,
       len(list_filter(ptext.t_labels, lambda x: x <> -100)) as n_supervised, array_to_string(ptext.t_ids, ',') as ids
from r join ptext on ptext.pool_idx = {sql_hash('pool' + str(SEED), 'r.sample_id')} % 5
where {sql_hash(SEED, 'r.sample_id')} < {P_TEXT} * 4294967296.0"""


@query("training_stream", TRAINING_SQL)
def training_stream(spark, sf):
    """VL samples (cache path, tokenised, masked, truncated, aligned) in
    sample order; after each, a text slot with p = r/(1-r) for r = 0.2,
    filled from the tokenised pool (broadcast: five rows).  Order of the
    stream is (vl_rank, is_text)."""
    vocab = corpus_vocab(spark, sf)
    vl = tokenized_samples_df(spark, sf).select("sample_id", "input_ids", "labels")
    slots = MX.mix_text(vl.select("sample_id"), "sample_id", 0.2, SEED)
    text = MX.pick_from_pool(slots.where("is_text"), "sample_id", pool_samples(spark, vocab), SEED,
                             len(K.TEXT_PROMPT_POOL))
    vl_rows = slots.where(~F.col("is_text")).join(vl, "sample_id") \
        .withColumn("pool_idx", F.lit(None).cast("bigint"))
    rows = vl_rows.unionByName(text.select("sample_id", "vl_rank", "is_text", "pool_idx", "input_ids", "labels"))
    return rows.select("sample_id", "vl_rank", "is_text", "pool_idx",
                       F.size("input_ids").cast("bigint").alias("n_tokens"),
                       AR.count_supervised("labels").cast("bigint").alias("n_supervised"),
                       AR.ids_to_text("input_ids").alias("ids"))
