"""Supervised chat samples from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import prompts as PR
from tessera.functions.text import STRIP_RE
from tessera.operators import fields, gates
from tessera.plans import fixtures as FX
from tessera.plans.fixture_sql import with_fixtures
from tessera.plans.artifacts import shared
from tessera.plans.registry import query
from tessera.operators.tokens import TOKEN_RE
from tessera.sources.corpus import scan_corpus

# SQL helpers for the oracle (DuckDB dialect).
def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP_RE}', '', 'g')"


IMG4 = ("'<|start_of_image|>' || repeat('<|image_soft_token|>', {n}) || '<|end_of_image|>'")


def chat_samples_df(spark, sf, n_img: int = 4):
    """Flagship: conversations -> (conv_id, prompt, answer).

    S1 scan -> P3 last turns -> P4 strip ``<image>`` -> F2 non-empty
    assistant -> P7 prompt with an ``n_img`` placeholder block -> P13
    terminated answer.  One partial+final aggregation on conv_id; the scan
    reads four columns.
    """
    conv = scan_corpus(spark, f"{sf}/conversations.parquet")
    long = conv.select(F.col("conv_id"), "turn",
                       F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt")
                       .otherwise(F.col("role")).alias("speaker"), F.col("text").alias("value"))
    turns = fields.last_turns(long, key="conv_id")
    kept = gates.require_assistant(turns, "assistant")
    return kept.select("conv_id", PR.render_prompt("human", n_img).alias("prompt"),
                       PR.answer_text("assistant").alias("answer"))


CHAT_SAMPLES_SQL = f"""
select conv_id,
  '[@BOS@]' || '<|start_of_turn|>user' || chr(10) || {IMG4.format(n=4)} || chr(10) || h || '<|end_of_turn|>'
    || '<|start_of_turn|>assistant' || chr(10) as prompt,
  a || '<|end_of_turn|>' as answer
from (select conv_id,
        case when count(*) filter (where role='user') = 0 then 'Describe this image.'
             else {sql_strip("replace(arg_max(text, turn) filter (where role='user'), '<image>', '')")} end h,
        coalesce({sql_strip("arg_max(text, turn) filter (where role='assistant')")}, '') a
      from conversations group by conv_id) q
where a <> ''"""


@query("chat_samples", CHAT_SAMPLES_SQL)
def chat_samples(spark, sf):
    return chat_samples_df(spark, sf)


# --- P3-P5: last turns of the long-form corpus ------------------------------

def _turn_sql(default: str) -> str:
    return f"""select sample_id,
  case when count(*) filter (where speaker='human') = 0 then '{default}'
       else {sql_strip("replace(arg_max(value, turn) filter (where speaker='human'), '<image>', '')")} end as human,
  coalesce({sql_strip("arg_max(value, turn) filter (where speaker='gpt')")}, '') as assistant,
  max(num_patches) as num_patches,
  min_by(value, turn) filter (where speaker='system') as system_text
from vl_conv group by sample_id"""


@query("last_turns", with_fixtures("select sample_id, human, assistant from lt", "vl_conv",
                                   extra={"lt": _turn_sql("Describe this image.")}))
def last_turns_q(spark, sf):
    return fields.last_turns(FX.vl_conv(spark, sf)).select("sample_id", "human", "assistant")


@query("cache_writer_turns", with_fixtures("select sample_id, human, assistant from lt where assistant <> ''",
                                           "vl_conv", extra={"lt": _turn_sql("")}))
def cache_writer_turns(spark, sf):
    """Cache-writer variant (P5): default prompt '' and F2 applied."""
    t = fields.last_turns(FX.vl_conv(spark, sf), default_prompt="")
    return gates.require_assistant(t).select("sample_id", "human", "assistant")


def _turns_with_extras(spark, sf, default_prompt):
    conv = FX.vl_conv(spark, sf)
    extras = [F.max("num_patches").alias("num_patches"),
              F.min_by("value", F.when(F.col("speaker") == "system", F.col("turn"))).alias("system_text")]
    return fields.last_turns(conv, default_prompt=default_prompt, extra_aggs=extras)


@query("system_prompts", with_fixtures(f"""
select sample_id,
  '[@BOS@]' || case when system_text is not null and system_text <> ''
     then '<|start_of_turn|>system' || chr(10) || system_text || '<|end_of_turn|>' else '' end
  || '<|start_of_turn|>user' || chr(10) || {IMG4.format(n="num_patches")} || chr(10) || human
  || '<|end_of_turn|><|start_of_turn|>assistant' || chr(10) as prompt,
  assistant || '<|end_of_turn|>' as answer
from lt where assistant <> ''""", "vl_conv", extra={"lt": _turn_sql("Describe this image.")}))
def system_prompts(spark, sf):
    """P7 with an optional system turn and N = num_patches placeholders."""
    t = gates.require_assistant(_turns_with_extras(spark, sf, "Describe this image."))
    return t.select("sample_id", PR.render_prompt("human", F.col("num_patches"), F.col("system_text")).alias("prompt"),
                    PR.answer_text("assistant").alias("answer"))


# --- P6, F3: first question-answer pair ------------------------------------

@query("first_qa", with_fixtures("""
select sample_id, question, answer from (
  select u.sample_id, u.value as question, a.value as answer,
         row_number() over (partition by u.sample_id order by u.turn) as rn
  from vl_conv u left join vl_conv a
    on a.sample_id = u.sample_id and a.turn = u.turn + 1 and a.speaker = 'gpt'
  where u.speaker = 'human') p
where rn = 1 and question is not null and question <> '' and answer is not null and answer <> ''""", "vl_conv"))
def first_qa_q(spark, sf):
    return gates.require_qa(fields.first_pair(FX.vl_conv(spark, sf)))


@query("first_qa_array", with_fixtures("""
select sample_id, question, answer from (
  select u.sample_id, u.value as question, a.value as answer,
         row_number() over (partition by u.sample_id order by u.turn) as rn
  from vl_conv u left join vl_conv a
    on a.sample_id = u.sample_id and a.turn = u.turn + 1 and a.speaker = 'gpt'
  where u.speaker = 'human') p
where rn = 1 and question is not null and question <> '' and answer is not null and answer <> ''
  and exists (select 1 from vl_conv i where i.sample_id = p.sample_id and i.image_ref is not null)""", "vl_conv"))
def first_qa_array(spark, sf):
    """P6 + F1 on the multi-QA shape as the loaders receive it
    (``images ARRAY<STRING>``, ``texts ARRAY<STRUCT<user, assistant>>``):
    the first image must be present, the first pair is ``get(texts, 0)``."""
    conv = FX.vl_conv(spark, sf)
    pairs = fields.qa_pairs(conv)
    # one sample's turns, in order, nulls kept: the first image is tested, not the first that is there
    images = conv.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("turn", "image_ref"))).alias("images"))
    images = images.withColumn("images", F.transform("images", lambda i: i["image_ref"]))
    rows = gates.require_asset(pairs.join(images, "sample_id"), "images", is_array=True)
    q, a = fields.first_qa("texts")
    return gates.require_qa(rows.select("sample_id", q.alias("question"), a.alias("answer")))


# --- F1: asset present -------------------------------------------------------

@query("asset_rows", with_fixtures(
    "select sample_id, turn, image_ref from vl_conv where image_ref is not null", "vl_conv"))
def asset_rows(spark, sf):
    return gates.require_asset(FX.vl_conv(spark, sf), "image_ref").select("sample_id", "turn", "image_ref")


# --- P8, P9, T6: text-only prompts and closed examples ------------------------

@query("text_samples", """
select conv_id, prompt, sample, len(regexp_extract_all(prefix, '{tok}')) as n_masked,
       len(regexp_extract_all(sample, '{tok}')) as n_tokens
from (select conv_id, prompt, sample,
             substring(sample, 1, instr(sample, 'assistant' || chr(10)) + 9) as prefix
      from (select conv_id,
              '[@BOS@]<|start_of_turn|>user' || chr(10) || q || '<|end_of_turn|><|start_of_turn|>assistant' || chr(10) as prompt,
              '[@BOS@]<|start_of_turn|>user' || chr(10) || q || '<|end_of_turn|><|start_of_turn|>assistant' || chr(10)
                || a || '<|end_of_turn|>' as sample
            from (select conv_id, arg_max(text, turn) filter (where role='user') q,
                         arg_max(text, turn) filter (where role='assistant') a
                  from conversations group by conv_id) t
            where q is not null and a is not null) s) p""".replace("{tok}", TOKEN_RE))
def text_samples(spark, sf):
    """Text-only prompt (P8), closed example (P9) and the number of masked
    label positions found by re-tokenising the prefix (T6)."""
    from tessera.operators.tokens import word_tokens
    c = scan_corpus(spark, f"{sf}/conversations.parquet")
    qa = c.groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("q"),
                                  F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"))
    qa = qa.where(F.col("q").isNotNull() & F.col("a").isNotNull())
    s = qa.select("conv_id", PR.render_text_prompt("q").alias("prompt"),
                  PR.render_text_sample("q", "a").alias("sample"))
    return s.select("conv_id", "prompt", "sample",
                    F.size(word_tokens(PR.supervision_prefix("sample"))).cast("bigint").alias("n_masked"),
                    F.size(word_tokens("sample")).cast("bigint").alias("n_tokens"))


# --- T1-T5, T7, T8, F5: tokenised training samples (cache path) -------------

def vocab_sql() -> str:
    return f"""select t, row_number() over (order by c desc, t) + 15 as id
from (select t, count(*) as c from (select unnest(regexp_extract_all(text, '{TOKEN_RE}')) as t from documents) x
      group by t) y"""


def _special_case(tok: str) -> str:
    from tessera.operators.tokens import SPECIAL_IDS
    whens = " ".join(f"when '{t}' then {i}" for t, i in SPECIAL_IDS.items())
    return f"case {tok} {whens} end"


def _tokens_sql(src: str, key: str, parts: list[str]) -> str:
    sel = []
    for i, p in enumerate(parts):
        sel.append(f"select {key} as k, {i} as part, unnest(regexp_extract_all({p}, '{TOKEN_RE}')) as tok, "
                   f"generate_subscripts(regexp_extract_all({p}, '{TOKEN_RE}'), 1) as pos from {src}")
    return " union all ".join(sel)


@query("build_vocab", with_fixtures("select t, id from vocab", extra={"vocab": vocab_sql()}))
def build_vocab_q(spark, sf):
    from tessera.operators.tokens import build_vocab
    return build_vocab(scan_corpus(spark, f"{sf}/documents.parquet")).select("t", "id")


def corpus_vocab(spark, sf):
    """The documents' vocabulary, materialized once per session: every
    tokenisation and decode of ``sf`` reads the same artifact."""
    from tessera.operators.tokens import build_vocab
    return shared(spark, sf, "vocab",
                  lambda: build_vocab(scan_corpus(spark, f"{sf}/documents.parquet"), materialize=True))


def tokenized_samples_df(spark, sf, max_length: int = 512):
    """E2 read side: last turns (cache-writer defaults) -> F2 -> prompt with
    ``num_patches`` placeholders -> tokenise prompt and answer separately
    (T1) -> attention mask (T3), whole-sequence image mask (T4), labels (T5)
    -> right-truncate (T7) -> counts (T8) -> drop misaligned rows (F5)."""
    from tessera.functions import arrays as AR
    from tessera.operators.tokens import build_vocab, tokenize
    vocab = corpus_vocab(spark, sf)
    t = gates.require_assistant(_turns_with_extras(spark, sf, ""))
    s = t.select("sample_id", "num_patches", PR.render_prompt("human", F.col("num_patches")).alias("prompt"),
                 PR.answer_text("assistant").alias("answer"))
    # T7 happens inside tokenize: the masks below are element-wise, so
    # truncating the ids first gives the same arrays as truncating all four
    tok = tokenize(s, "sample_id", ["prompt", "answer"], vocab, max_length=max_length)
    full = tok.select("sample_id", "num_patches", "n_prompt", "input_ids",
                      AR.attention_mask("input_ids").alias("attention_mask"),
                      AR.image_mask("input_ids").alias("image_mask"),
                      AR.mask_labels("input_ids", "n_prompt").alias("labels"))
    full = full.withColumn("n_image", AR.count_true("image_mask").cast("bigint"))
    return gates.check_alignment(full, "n_image", "num_patches", "drop")


TOKENIZED_SQL = with_fixtures(f"""
select sample_id, n_prompt, len(t_ids) as n_tokens, len(t_ids) as n_attended, n_image, len(t_ids) - n_image as n_text,
       len(list_filter(t_labels, lambda x: x <> -100)) as n_supervised,
       array_to_string(t_ids, ',') as ids, array_to_string(t_labels, ',') as labels
from (select sample_id, np, n_prompt, t_ids, t_labels,
             len(list_filter(t_ids, lambda x: x = 8)) as n_image
      from (select a.k as sample_id, s.num_patches as np, a.n_prompt,
                   list_slice(a.ids, 1, 512) as t_ids,
                   list_slice(list_transform(a.ids, lambda x, i: case when i <= a.n_prompt then -100 else x end), 1, 512) as t_labels
            from agg a join s on a.k = s.sample_id) z) y
where n_image = np""", "vl_conv", extra={
    "vocab": vocab_sql(),
    "lt": _turn_sql(""),
    "s": f"""select sample_id, num_patches,
  '[@BOS@]<|start_of_turn|>user' || chr(10) || {IMG4.format(n="num_patches")} || chr(10) || human
    || '<|end_of_turn|><|start_of_turn|>assistant' || chr(10) as prompt,
  assistant || '<|end_of_turn|>' as answer from lt where assistant <> ''""",
    "tk": _tokens_sql("s", "sample_id", ["prompt", "answer"]),
    "ti": f"select k, part, pos, coalesce({_special_case('tok')}, vocab.id, 0) as id from tk left join vocab on tk.tok = vocab.t",
    "agg": "select k, list(id order by part, pos) as ids, count(*) filter (where part = 0) as n_prompt from ti group by k",
})


@query("tokenized_samples", TOKENIZED_SQL)
def tokenized_samples(spark, sf):
    from tessera.functions import arrays as AR
    d = tokenized_samples_df(spark, sf)
    return d.select("sample_id", F.col("n_prompt").cast("bigint").alias("n_prompt"),
                    F.size("input_ids").cast("bigint").alias("n_tokens"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda n, x: n + x).alias("n_attended"), "n_image",
                    (F.size("input_ids") - F.col("n_image")).cast("bigint").alias("n_text"),
                    AR.count_supervised("labels").cast("bigint").alias("n_supervised"),
                    AR.ids_to_text("input_ids").alias("ids"), AR.ids_to_text("labels").alias("labels"))


# --- T9, T10: decoding generated ids ------------------------------------------

@query("decode_tail", with_fixtures("""
select s.sample_id, coalesce(c.n_ans - c.off, 0) as n_new, coalesce(d.response, '') as response
from s left join c on c.k = s.sample_id
left join (select ti.k, string_agg(vocab.t, ' ' order by ti.pos) as response
           from ti join vocab on ti.id = vocab.id join c on c.k = ti.k
           where ti.part = 1 and ti.pos > c.off group by ti.k) d on d.k = s.sample_id""",
    "vl_conv", extra={
        "vocab": vocab_sql(),
        "lt": _turn_sql(""),
        "s": f"""select sample_id, num_patches,
  '[@BOS@]<|start_of_turn|>user' || chr(10) || {IMG4.format(n="num_patches")} || chr(10) || human
    || '<|end_of_turn|><|start_of_turn|>assistant' || chr(10) as prompt,
  assistant || '<|end_of_turn|>' as answer from lt where assistant <> ''""",
        "tk": _tokens_sql("s", "sample_id", ["prompt", "answer"]),
        "ti": f"select k, part, pos, coalesce({_special_case('tok')}, vocab.id, 0) as id from tk left join vocab on tk.tok = vocab.t",
        # an odd sample returns only new ids; when they outnumber the prompt the
        # repair does not fire and the prompt-length slice eats into them
        "c": """select k, n_prompt, n_ans,
               case when k % 2 = 1 and n_ans >= n_prompt + 1 then n_prompt else 0 end as off
               from (select k, count(*) filter (where part = 0) as n_prompt,
                            count(*) filter (where part = 1) as n_ans from ti group by k) q""",
    }))
def decode_tail(spark, sf):
    """Generated ids come in two shapes: even samples return prompt+new ids,
    odd samples only the new ids.  T10 repairs the second shape, T9 slices
    off the prompt and decodes without special tokens."""
    from tessera.functions import arrays as AR
    from tessera.operators.tokens import build_vocab, decode_ids, tokenize
    vocab = corpus_vocab(spark, sf)
    t = gates.require_assistant(_turns_with_extras(spark, sf, ""))
    s = t.select("sample_id", PR.render_prompt("human", F.col("num_patches")).alias("prompt"),
                 PR.answer_text("assistant").alias("answer"))
    t = tokenize(s, "sample_id", ["prompt", "answer"], vocab, "_ids", "n_prompt")   # one pass, both parts
    a = t.withColumn("prompt_ids", F.slice("_ids", F.lit(1), F.col("n_prompt"))) \
        .withColumn("answer_ids", F.slice("_ids", F.col("n_prompt") + 1,
                                          F.greatest(F.size("_ids") - F.col("n_prompt"), F.lit(0))))
    gen = a.withColumn("output_ids", F.when(F.col("sample_id") % 2 == 0,
                                            F.concat("prompt_ids", "answer_ids")).otherwise(F.col("answer_ids")))
    fixed = gen.withColumn("output_ids", AR.normalize_output("prompt_ids", "output_ids"))
    new = fixed.withColumn("new_ids", AR.new_tokens("output_ids", F.size("prompt_ids")))
    dec = decode_ids(new, "sample_id", "new_ids", vocab, "response")
    return dec.select("sample_id", F.size("new_ids").cast("bigint").alias("n_new"), "response")


# --- T2 unknown check: vocabulary coverage of the answers ---------------------

@query("vocab_coverage", with_fixtures("""
select k as conv_id, count(*) as n_tokens, count(*) filter (where id = 0) as n_unknown
from ti group by k""", extra={
    "vocab": vocab_sql(),
    "s": f"select conv_id, answer from ({CHAT_SAMPLES_SQL}) c",
    "tk": _tokens_sql("s", "conv_id", ["answer"]),
    "ti": f"select k, part, pos, coalesce({_special_case('tok')}, vocab.id, 0) as id from tk left join vocab on tk.tok = vocab.t",
}))
def vocab_coverage(spark, sf):
    """T2 unknown check: tokens of each chat answer that the documents'
    vocabulary does not know (id 0), next to the answer's length."""
    from tessera.operators.tokens import UNK_ID, tokenize
    s = chat_samples_df(spark, sf).select("conv_id", "answer")
    t = tokenize(s, "conv_id", ["answer"], corpus_vocab(spark, sf))
    return t.select("conv_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    F.size(F.filter("input_ids", lambda x: x == F.lit(UNK_ID))).cast("bigint").alias("n_unknown"))
