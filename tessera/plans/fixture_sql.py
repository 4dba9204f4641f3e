"""SQL twins of the derived fixtures, for the DuckDB oracle.

Only the raw tables are registered on the oracle side, so each oracle query
inlines the fixtures it reads as CTEs via ``with_fixtures``.
"""

from __future__ import annotations

FIXTURE_SQL = {
    "vl_conv": """
select conv_id as sample_id, turn,
  case role when 'user' then 'human' when 'assistant' then 'gpt' else role end as speaker,
  case when role='user' and turn<=1 then concat('<image>', chr(10), text) else text end as value,
  case when conv_id % 10 = 9 then null else concat('img_', cast(conv_id % 250 as varchar), '.png') end as image_ref,
  conv_id % 7 + 1 as num_patches
from conversations""",
    "img_dims": """
select event_id as image_id, 320 + event_id % 900 as w, 240 + event_id % 700 as h from events""",
    "gui_targets": """
select event_id as sample_id,
  case when event_id % 17 = 0 then null when event_id % 19 = 0 then '' else concat('tap the ', event_type) end as instruction,
  case event_id % 3 when 0 then 'dict' when 1 then 'list' else 'str' end as kind,
  value/500 as x, value/1000 as y,
  case event_id % 10 when 0 then 'click(x=0.45, y=0.72)' when 1 then 'type(text="hello world")'
    when 2 then 'scroll(direction="down")' when 3 then 'drag(startX=0.1, startY=0.2, endX=0.5, endY=0.8)'
    when 4 then 'long_press(x=0.3, y=0.5)' when 5 then 'done()' when 6 then 'double_click(x=0.1, y=0.2)'
    when 7 then 'no action here' when 8 then 'click(x=1.2.3, y=0.1)' else 'type(text="")' end as target_text
from events""",
    "gui_steps": """
select event_id as sample_id, user_id, concat('do ', event_type) as instruction,
  case when event_id % 3 = 0 then null else concat('see ', event_type) end as thought,
  case event_id % 4 when 0 then concat('scroll(direction="down")', chr(10), 'done()')
    when 1 then 'click(x=0.45, y=0.72)' when 2 then concat('noise', chr(10), 'type(text="hello world")')
    else 'long_press(x=0.3, y=0.5)' end as action,
  coalesce(list(event_type) over (partition by user_id order by ts, event_id
    rows between unbounded preceding and 1 preceding), []) as history_list
from events""",
    "microsteps": """
select event_type as stage,
  row_number() over (partition by event_type order by event_id) - 1 as micro_idx, value/100 as loss
from events""",
    "step_log": """
select stage, step,
  concat('Step ', cast(step as varchar), ' | Loss: ', cast(cast(floor(c/10000) as bigint) as varchar), '.',
    lpad(cast(c % 10000 as varchar),4,'0'), ' | LR: 1.00e-03 | ', cast(step as varchar), '.5m') as line
from (select event_type as stage, row_number() over (partition by event_type order by event_id) * 10 as step,
        cast(round(value*100) as bigint) as c from events) q""",
    "evals": """
select doc_id, case when doc_id % 2 = 0 then 'step_500' else 'step_1000' end as run,
  cast(floor(doc_id/2) as bigint) as prompt_id, lang as suite, text as response,
  n_chars % 64 as tokens, cast((doc_id % 5) * 0.5 as double) as elapsed_s
from documents""",
    "tensor_catalog": """
select concat('model.', case when l_orderkey % 2 = 0 then 'visual.blocks.' else 'layers.' end,
    cast(l_partkey % 27 as varchar), '.',
    case l_returnflag when 'A' then 'attn' when 'N' then 'mlp' else 'gate' end,
    '.w', cast(l_orderkey as varchar), '_', cast(l_linenumber as varchar)) as name,
  l_suppkey + 1 as dim0, cast(l_quantity as bigint) as dim1, 2 as elem_bytes, l_linestatus = 'O' as trainable
from lineitem""",
    "feat": """
select cast(floor(vec_id/100) as bigint) as shard_id, vec_id % 100 as pos, vec_id as id, embedding as feature
from embeddings""",
}


def with_fixtures(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``with <fixtures>, <extra> <body>``: fixtures first, then extra CTEs."""
    parts = [f"{n} as ({FIXTURE_SQL[n]})" for n in names]
    parts += [f"{k} as ({v})" for k, v in (extra or {}).items()]
    if not parts:
        return body
    return "with " + ",\n".join(parts) + "\n" + body
