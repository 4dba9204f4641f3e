"""Grounding and trajectory corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import actions as AC
from tessera.functions import prompts as PR
from tessera.functions.text import ASCII_DIGITS, UNICODE_DIGITS, py_strip
from tessera.operators import fields, gates
from tessera.operators.actions import parse_action_df
from tessera.plans import fixtures as FX
from tessera.plans.fixture_sql import with_fixtures
from tessera.plans.registry import query
from tessera.plans.samples import sql_strip


def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_float(x: str) -> str:
    return f"try_cast(translate({x}, {sql_lit(UNICODE_DIGITS)}, {sql_lit(ASCII_DIGITS)}) as double)"


def sql_parse_action(src: str) -> dict[str, str]:
    """DuckDB twin of ``actions.parse_action``: field -> SQL expression."""
    t = sql_strip(src)
    m = lambda p: f"regexp_matches({t}, {sql_lit(p)})"
    g = lambda p, i: f"regexp_extract({t}, {sql_lit(p)}, {i})"
    kind = (f"case when {m(AC.CLICK_RE)} then 'click' when {m(AC.TYPE_RE)} then 'type' "
            f"when {m(AC.SCROLL_RE)} then 'scroll' when {m(AC.DRAG_RE)} then 'drag' "
            f"when {m(AC.LONG_PRESS_RE)} then 'long_press' when {m(AC.DONE_RE)} then 'done' end")
    return {
        "action_type": kind,
        "x": f"case when {m(AC.CLICK_RE)} then {sql_float(g(AC.CLICK_RE, 1))} "
             f"when {m(AC.TYPE_RE)} or {m(AC.SCROLL_RE)} or {m(AC.DRAG_RE)} then null "
             f"when {m(AC.LONG_PRESS_RE)} then {sql_float(g(AC.LONG_PRESS_RE, 1))} end",
        "y": f"case when {m(AC.CLICK_RE)} then {sql_float(g(AC.CLICK_RE, 2))} "
             f"when {m(AC.TYPE_RE)} or {m(AC.SCROLL_RE)} or {m(AC.DRAG_RE)} then null "
             f"when {m(AC.LONG_PRESS_RE)} then {sql_float(g(AC.LONG_PRESS_RE, 2))} end",
        "text": f"case when {m(AC.CLICK_RE)} then null when {m(AC.TYPE_RE)} then {g(AC.TYPE_RE, 1)} end",
        "direction": f"case when {m(AC.CLICK_RE)} or {m(AC.TYPE_RE)} then null "
                     f"when {m(AC.SCROLL_RE)} then {g(AC.SCROLL_RE, 1)} end",
        **{f: f"case when {m(AC.CLICK_RE)} or {m(AC.TYPE_RE)} or {m(AC.SCROLL_RE)} then null "
              f"when {m(AC.DRAG_RE)} then {sql_float(g(AC.DRAG_RE, i))} end"
           for i, f in enumerate(["start_x", "start_y", "end_x", "end_y"], start=1)},
    }


def _flat(a):
    return [a[f].alias(f) for f in AC.ACTION_FIELDS]


# --- X1, X4: parse one action per record --------------------------------------

def _parse_sql():
    p = sql_parse_action("target_text")
    cols = ", ".join(f"{v} as {k}" for k, v in p.items())
    return with_fixtures(f"""
select sample_id, {", ".join(AC.ACTION_FIELDS)},
  coalesce(action_type in ('click','type','scroll','drag','long_press','done')
    and (x is null or x between 0 and 1) and (y is null or y between 0 and 1)
    and (start_x is null or start_x between 0 and 1) and (start_y is null or start_y between 0 and 1)
    and (end_x is null or end_x between 0 and 1) and (end_y is null or end_y between 0 and 1)
    and not (action_type in ('click','long_press') and (x is null or y is null))
    and not (action_type = 'drag' and (start_x is null or start_y is null or end_x is null or end_y is null)),
    false) as valid
from (select sample_id, {cols} from gui_targets) q""", "gui_targets")


@query("parse_action", _parse_sql())
def parse_action_q(spark, sf):
    t = parse_action_df(FX.gui_targets(spark, sf).select("sample_id", "target_text"), "target_text", "a")
    return t.select("sample_id", *_flat(F.col("a")), AC.validate_action("a").alias("valid"))


# --- X2, A11: parse all actions of a multi-line response ------------------------

def _lines_sql():
    p = sql_parse_action("line")
    cols = ", ".join(f"{v} as {k}" for k, v in p.items())
    return f"""select sample_id, line_no, {cols} from (
  select sample_id, unnest(string_split({sql_strip('action')}, chr(10))) as line,
         generate_subscripts(string_split({sql_strip('action')}, chr(10)), 1) as line_no
  from gui_steps) l"""


@query("parse_actions", with_fixtures(
    f"select sample_id, line_no, {', '.join(AC.ACTION_FIELDS)} from pl where action_type is not null",
    "gui_steps", extra={"pl": _lines_sql()}))
def parse_actions_q(spark, sf):
    s = FX.gui_steps(spark, sf)
    lines = s.select("sample_id", F.posexplode(F.split(py_strip("action"), "\n", -1)).alias("i", "line"))
    p = parse_action_df(lines.select("sample_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "line"),
                        "line", "a").where(F.col("a").isNotNull())
    return p.select("sample_id", "line_no", *_flat(F.col("a")))


@query("action_counts", with_fixtures("""
select s.sample_id, coalesce(c.n, 0) as n_actions, coalesce(c.first_type, '') as first_type from gui_steps s
left join (select sample_id, count(*) as n, arg_min(action_type, line_no) as first_type
           from pl where action_type is not null group by sample_id) c on c.sample_id = s.sample_id""",
    "gui_steps", extra={"pl": _lines_sql()}))
def action_counts(spark, sf):
    """Parsed actions per response (A11) from the array form of X2."""
    s = FX.gui_steps(spark, sf).select("sample_id", AC.parse_actions("action").alias("acts"))
    return s.select("sample_id", F.size("acts").cast("bigint").alias("n_actions"),
                    F.coalesce(F.get("acts", 0)["action_type"], F.lit("")).alias("first_type"))


# --- P10-P12, X3: trajectory prompts and targets --------------------------------

@query("trajectory_prompts", with_fixtures(f"""
select sample_id,
  case when len(history_list) = 0 then instruction
       else instruction || chr(10) || chr(10) || 'Previous actions:' || chr(10)
            || array_to_string(list_slice(history_list, greatest(len(history_list) - 2, 1), len(history_list)), chr(10))
  end as prompt,
  concat_ws(chr(10), case when thought is not null and thought <> '' then '<think>' || thought || '</think>' end,
            {sql_strip('action')}) as target,
  {sql_lit(K.AGENTIC_SYSTEM_PROMPT)} as system_prompt
from gui_steps""", "gui_steps"))
def trajectory_prompts(spark, sf):
    s = FX.gui_steps(spark, sf)
    return s.select("sample_id", PR.history_prompt("instruction", "history_list").alias("prompt"),
                    PR.thought_action_target("thought", "action").alias("target"),
                    PR.system_prompt(F.lit("agentic")).alias("system_prompt"))


@query("split_thought", with_fixtures(f"""
select sample_id, thought, {sql_strip("regexp_replace(target, '(?s)<think>(.*?)</think>', '', 'g')")} as action
from (select sample_id, case when regexp_matches(target, '(?s)<think>(.*?)</think>')
        then regexp_extract(target, '(?s)<think>(.*?)</think>', 1) end as thought, target
      from (select sample_id, concat_ws(chr(10), case when thought is not null and thought <> ''
              then '<think>' || thought || '</think>' end, {sql_strip('action')}) as target from gui_steps) a) b""",
    "gui_steps"))
def split_thought_q(spark, sf):
    """The inverse of P11 recovers thought and action."""
    s = FX.gui_steps(spark, sf).select("sample_id", PR.thought_action_target("thought", "action").alias("target"))
    th, rest = AC.split_thought("target")
    return s.select("sample_id", th.alias("thought"), rest.alias("action"))


# --- P1, P2, F4: grounding targets ----------------------------------------------

def _target_map():
    """Dict targets arrive with variant keys: (x_norm, y_norm), x only, or
    (x, y); a list target is [x, y]."""
    sid = F.col("sample_id")
    return (F.when(sid % 4 == 0, F.create_map(F.lit("x_norm"), F.col("x"), F.lit("y_norm"), F.col("y")))
            .when(sid % 4 == 1, F.create_map(F.lit("x"), F.col("x")))
            .otherwise(F.create_map(F.lit("x"), F.col("x"), F.lit("y"), F.col("y"))))


_GROUNDING_TARGETS_SQL = with_fixtures(f"""
select sample_id, instruction,
  case kind when 'dict' then 'click(x=' || printf('%.4f', x) || ', y=' || printf('%.4f', case when sample_id % 4 = 1 then 0.0 else y end) || ')'
            when 'list' then 'click(x=' || printf('%.4f', x) || ', y=' || printf('%.4f', y) || ')'
            else {sql_strip('target_text')} end as target,
  {K.IMAGE_TOKEN_ID} * 0 + 1 as n_targets
from gui_targets
where instruction is not null and instruction <> '' and target_text is not null and target_text <> ''""",
    "gui_targets")


@query("grounding_targets", _GROUNDING_TARGETS_SQL)
def grounding_targets(spark, sf):
    g = FX.gui_targets(spark, sf).withColumn("target", _target_map())
    kept = gates.require_target(g, "instruction", "target_text")
    x = fields.resolve_alias_map("target", ["x", "x_norm"], 0.0)
    y = fields.resolve_alias_map("target", ["y", "y_norm"], 0.0)
    t = fields.canonical_target("kind", x=x, y=y, xy=F.array("x", "y"), text="target_text")
    kept = kept.select("sample_id", "instruction", t.alias("target"), F.lit(1).alias("n_targets"))
    return kept.where(F.col("target").isNotNull())


def target_variant_df(spark, sf):
    """Grounding records whose target arrives as one JSON value, as in the
    hub rows: an object (x/y, x_norm/y_norm, or x only), a list [x, y], or
    a string; ingested as VARIANT."""
    g = FX.gui_targets(spark, sf)
    sid = F.col("sample_id")
    obj = (F.when(sid % 4 == 0, F.to_json(F.struct(F.col("x").alias("x_norm"), F.col("y").alias("y_norm"))))
           .when(sid % 4 == 1, F.to_json(F.struct("x")))
           .otherwise(F.to_json(F.struct("x", "y"))))
    as_str = F.variant_get(F.parse_json(F.to_json(F.struct(F.col("target_text").alias("s")))), "$.s", "variant")
    v = (F.when(F.col("kind") == "dict", F.parse_json(obj))
         .when(F.col("kind") == "list", F.parse_json(F.to_json(F.array("x", "y"))))
         .otherwise(as_str))
    return g.select("sample_id", "instruction", "target_text", v.alias("target"))


@query("grounding_targets_variant", _GROUNDING_TARGETS_SQL)
def grounding_targets_variant(spark, sf):
    """P1 + P2 + F4 with the target as a VARIANT column: key presence and
    shape are read from the value itself, not from a kind column."""
    g = gates.require_target(target_variant_df(spark, sf), "instruction", "target_text")
    g = g.select("sample_id", "instruction", fields.canonical_target_variant("target").alias("target"),
                 F.lit(1).alias("n_targets"))
    return g.where(F.col("target").isNotNull())


# Targets of every JSON type, and what each becomes (null: skipped).  x and y
# are the record's own numbers.
ODD_TARGETS = [
    ('{"x": null, "y": 0.5}', None), ('{"x": "0.5", "y": 0.5}', None), ("{}", None), ("[]", None),
    ('["a", 0.5]', None), ("[null, 0.5]", None), ("0", None), ("false", None), ("null", None), ('""', None),
    ('" "', ""), ('{"x_norm": 1, "y": 0.25}', "click(x=1.0000, y=0.2500)"), ('{"z": 1}', "click(x=0.0000, y=0.0000)"),
    ("[1, 2.5, 3]", "click(x=1.0000, y=2.5000)"), ('" done() "', "done()"), ("true", "True"), ("17", "17"),
    ('["a"]', "['a']"), ("[0.5]", "[0.5]"), ("[true]", "[True]"), ("[null]", "[None]"), ('["it\'s"]', '["it\'s"]'),
    ('["a \\"b\\" it\'s"]', "['a \"b\" it\\'s']")]


@query("odd_targets", with_fixtures(f"""
select sample_id, target from gui_targets
join (values {", ".join(f"({i}, {'null' if t is None else sql_lit(t)})" for i, (_, t) in enumerate(ODD_TARGETS))}) o(k, target)
  on sample_id % {len(ODD_TARGETS)} = k
where instruction is not null and instruction <> '' and target is not null""", "gui_targets"))
def odd_targets(spark, sf):
    """F4 + P1 + P2 on targets of every JSON type: empty values are gated,
    coordinates that are no numbers give no target."""
    g = FX.gui_targets(spark, sf).select("sample_id", "instruction")
    raw = F.element_at(F.array(*[F.lit(j) for j, _ in ODD_TARGETS]),
                       (F.col("sample_id") % len(ODD_TARGETS) + 1).cast("int"))
    g = gates.require_target_variant(g.withColumn("target", F.parse_json(raw)), "instruction", "target")
    g = g.select("sample_id", fields.canonical_target_variant("target").alias("target"))
    return g.where(F.col("target").isNotNull())


@query("grounding_quarantine", with_fixtures(f"""
select sample_id, reason as reject_reason from (
  select sample_id, case
    when instruction is null or instruction = '' then 'missing instruction'
    when target_text is null or target_text = '' then 'missing target'
    when action_type is null then 'no action'
    when (action_type in ('click','long_press') and (x is null or y is null)) then 'unparseable coordinate'
    end as reason
  from (select sample_id, instruction, target_text, {", ".join(f"{v} as {k}" for k, v in sql_parse_action("target_text").items())}
        from gui_targets) p) q
where reason is not null""", "gui_targets"))
def grounding_quarantine(spark, sf):
    """rows a loader would skip, with the reason, instead of dropping them."""
    g = parse_action_df(FX.gui_targets(spark, sf), "target_text", "a")
    reasons = [("missing instruction", F.col("instruction").isNull() | (F.col("instruction") == "")),
               ("missing target", F.col("target_text").isNull() | (F.col("target_text") == "")),
               ("no action", F.col("a").isNull()),
               ("unparseable coordinate", AC.coordinate_error("a").isNotNull())]
    _, rejects = gates.quarantine(g, reasons)
    return rejects.select("sample_id", "reject_reason")


@query("alias_columns", with_fixtures(f"""
select sample_id, instruction, {sql_strip('target_text')} as target from gui_targets
where instruction is not null and instruction <> '' and target_text is not null and target_text <> ''""",
    "gui_targets"))
def alias_columns(spark, sf):
    """P1 on column names: a corpus that calls its fields ``query`` and
    ``answer`` resolves to (instruction, target) by key absence, chosen
    once from the schema."""
    g = FX.gui_targets(spark, sf).withColumnRenamed("instruction", "query") \
        .withColumnRenamed("target_text", "answer")
    instr = fields.resolve_alias_columns(g, ["instruction", "query"], "")
    target = fields.resolve_alias_columns(g, ["target", "answer", "action"], "")
    r = g.select("sample_id", instr.alias("instruction"), target.alias("target_raw"))
    kept = gates.require_target(r, "instruction", "target_raw")
    return kept.select("sample_id", "instruction", py_strip("target_raw").alias("target"))


# --- grounding samples, live path (E1): G1-G3, P1, P2, P7+P12, T1, T4, T5, T7, F4, F5 --

GROUNDING_MAX_LEN = 1024


def grounding_samples_df(spark, sf):
    from tessera.functions import arrays as AR
    from tessera.functions import geometry as GE
    from tessera.operators.tokens import PromptTemplate, tokenize
    from tessera.plans.samples import corpus_vocab
    vocab = corpus_vocab(spark, sf)
    g = FX.gui_targets(spark, sf).withColumn("target", _target_map())
    g = gates.require_target(g, "instruction", "target_text")                     # F4 before strip
    x = fields.resolve_alias_map("target", ["x", "x_norm"], 0.0)
    y = fields.resolve_alias_map("target", ["y", "y_norm"], 0.0)
    t = fields.canonical_target("kind", x=x, y=y, xy=F.array("x", "y"), text="target_text")
    # image size of the sample (the img_dims view of the same events row)
    w = F.lit(320) + F.col("sample_id") % 900
    h = F.lit(240) + F.col("sample_id") % 700
    nw, nh = GE.resize_plan(w, h)
    s = g.select("sample_id", "instruction", t.alias("answer"), GE.num_image_tokens(nw, nh).alias("n_img"))
    # instruction and answer tokenised separately, in one pass
    tok = tokenize(s, "sample_id", ["instruction", "answer"], vocab, "_ids", "_nu")
    user_ids = F.slice("_ids", F.lit(1), F.col("_nu"))
    ans_ids = F.slice("_ids", F.col("_nu") + 1, F.greatest(F.size("_ids") - F.col("_nu"), F.lit(0)))
    tpl = PromptTemplate(spark, vocab, K.GROUNDING_SYSTEM_PROMPT)
    p = tok.select("sample_id", "n_img", tpl.prompt_ids(user_ids, "n_img").alias("prompt_ids"),
                   tpl.answer_ids(ans_ids).alias("answer_ids"))
    # F5, processor rule: the prompt's placeholders must equal the patch count
    p = p.withColumn("_n_ph", AR.count_true(AR.image_mask("prompt_ids")))
    p = gates.check_alignment(p, "_n_ph", "n_img", "fail")
    full = p.select("sample_id", "n_img", F.size("prompt_ids").alias("n_prompt"),
                    F.concat("prompt_ids", "answer_ids").alias("ids"))
    # T4 live scope (answer forced false), T5 labels, then T7 (never re-checked)
    full = full.select("sample_id", "n_img", "n_prompt",
                       AR.truncate("ids", GROUNDING_MAX_LEN).alias("input_ids"),
                       AR.truncate(AR.image_mask("ids", "n_prompt"), GROUNDING_MAX_LEN).alias("image_mask"),
                       AR.truncate(AR.mask_labels("ids", "n_prompt"), GROUNDING_MAX_LEN).alias("labels"))
    return full


def _grounding_sql():
    from tessera.plans.samples import _special_case, _tokens_sql, vocab_sql
    w = "(320 + sample_id % 900)"
    h = "(240 + sample_id % 700)"
    from tessera.plans.geometry import _resize_sql
    rw, rh = _resize_sql(w, h, 672)
    canon = (f"case kind when 'dict' then 'click(x=' || printf('%.4f', x) || ', y=' || "
             f"printf('%.4f', case when sample_id % 4 = 1 then 0.0 else y end) || ')' "
             f"when 'list' then 'click(x=' || printf('%.4f', x) || ', y=' || printf('%.4f', y) || ')' "
             f"else {sql_strip('target_text')} end")
    s = f"""select sample_id, n_img,
  '[@BOS@]<|start_of_turn|>system' || chr(10) || {sql_lit(K.GROUNDING_SYSTEM_PROMPT)} || '<|end_of_turn|>'
    || '<|start_of_turn|>user' || chr(10) || '<|start_of_image|>' || repeat('<|image_soft_token|>', n_img)
    || '<|end_of_image|>' || chr(10) || instruction || '<|end_of_turn|><|start_of_turn|>assistant' || chr(10) as prompt,
  ({canon}) || '<|end_of_turn|>' as answer
from (select *, (({rh}) // 16 // 2) * (({rw}) // 16 // 2) as n_img from gui_targets
      where instruction is not null and instruction <> '' and target_text is not null and target_text <> '') q"""
    body = f"""
select sample_id, n_img, n_prompt, len(t_ids) as n_tokens,
       len(list_filter(t_mask, lambda b: b)) as n_image,
       len(list_filter(t_labels, lambda x: x <> -100)) as n_supervised,
       array_to_string(t_ids, ',') as ids
from (select a.k as sample_id, s.n_img, a.n_prompt,
             list_slice(a.ids, 1, {GROUNDING_MAX_LEN}) as t_ids,
             list_slice(list_transform(a.ids, lambda x, i: x = 8 and i <= a.n_prompt), 1, {GROUNDING_MAX_LEN}) as t_mask,
             list_slice(list_transform(a.ids, lambda x, i: case when i <= a.n_prompt then -100 else x end), 1, {GROUNDING_MAX_LEN}) as t_labels
      from agg a join s on a.k = s.sample_id) z"""
    return with_fixtures(body, "gui_targets", extra={
        "vocab": vocab_sql(), "s": s,
        "tk": _tokens_sql("s", "sample_id", ["prompt", "answer"]),
        "ti": f"select k, part, pos, coalesce({_special_case('tok')}, vocab.id, 0) as id from tk left join vocab on tk.tok = vocab.t",
        "agg": "select k, list(id order by part, pos) as ids, count(*) filter (where part = 0) as n_prompt from ti group by k",
    })


@query("grounding_samples", _grounding_sql())
def grounding_samples(spark, sf):
    """Grounding training samples on the live path: resize plan and image
    token count (G1-G3), grounding system prompt (P12) in the chat prompt
    (P7), canonical target (P1, P2) as the answer (P13), ids assembled from
    the template and the tokenised text (T1), placeholder check in fail mode
    (F5), prompt-only image mask (T4), labels (T5), truncation to 1024 (T7)."""
    from tessera.functions import arrays as AR
    d = grounding_samples_df(spark, sf)
    return d.select("sample_id", F.col("n_img").cast("bigint").alias("n_img"),
                    F.col("n_prompt").cast("bigint").alias("n_prompt"),
                    F.size("input_ids").cast("bigint").alias("n_tokens"),
                    AR.count_true("image_mask").cast("bigint").alias("n_image"),
                    AR.count_supervised("labels").cast("bigint").alias("n_supervised"),
                    AR.ids_to_text("input_ids").alias("ids"))
