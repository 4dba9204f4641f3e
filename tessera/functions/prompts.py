"""Chat-template rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import col_, is_blank, py_strip

NL = "\n"


def image_block(n_img) -> Column:
    """``<|start_of_image|>`` + n placeholders + ``<|end_of_image|>``."""
    n = n_img if isinstance(n_img, Column) else F.lit(n_img)
    return F.concat(F.lit(K.START_OF_IMAGE), F.repeat(F.lit(K.IMAGE_SOFT_TOKEN), n),
                    F.lit(K.END_OF_IMAGE))


def render_prompt(user, n_img, system=None) -> Column:
    """Image chat prompt (P7): BOS, optional system turn, user turn with the
    image block, and the opening of the assistant turn."""
    user = col_(user)
    sys_part = F.lit("")
    if system is not None:
        s = col_(system) if not isinstance(system, str) else F.lit(system)
        sys_part = F.when(~is_blank(s), F.concat(F.lit(K.START_OF_TURN + "system" + NL), s,
                                                 F.lit(K.END_OF_TURN))).otherwise(F.lit(""))
    return F.concat(F.lit(K.BOS), sys_part,
                    F.lit(K.START_OF_TURN + "user" + NL), image_block(n_img), F.lit(NL), user,
                    F.lit(K.END_OF_TURN), F.lit(K.START_OF_TURN + "assistant" + NL))


def render_text_prompt(user) -> Column:
    """Text-only prompt (P8); a system prompt is ignored on this path."""
    return F.concat(F.lit(K.BOS + K.START_OF_TURN + "user" + NL), col_(user),
                    F.lit(K.END_OF_TURN + K.START_OF_TURN + "assistant" + NL))


def answer_text(answer) -> Column:
    """Answer followed by the turn terminator."""
    return F.concat(col_(answer), F.lit(K.END_OF_TURN))


def render_text_sample(question, answer) -> Column:
    """Closed text-only training example."""
    return F.concat(render_text_prompt(question), answer_text(answer))


def supervision_prefix(sample) -> Column:
    """Prefix of a closed example up to and including the first
    ``assistant\\n``; supervision starts after it (P9)."""
    s = col_(sample)
    marker = "assistant" + NL
    return F.substring(s, F.lit(1), F.instr(s, marker) + F.lit(len(marker) - 1))


def history_prompt(instruction, history_list=None, history_text=None, keep: int = 3) -> Column:
    """Instruction, blank line, ``Previous actions:`` and the last ``keep``
    history items (P10).  A string history passes whole; an empty one adds
    nothing."""
    instr = col_(instruction)
    hist = F.lit(None).cast("string")
    if history_list is not None:
        h = col_(history_list)
        start = F.greatest(F.size(h) - F.lit(keep - 1), F.lit(1))
        joined = F.array_join(F.slice(h, start, F.lit(keep)), NL)
        hist = F.when(F.size(h) > 0, joined)
    if history_text is not None:
        ht = col_(history_text)
        hist = F.coalesce(hist, F.when(~is_blank(ht), ht))
    return F.when(hist.isNull(), instr).otherwise(
        F.concat(instr, F.lit(NL + NL + "Previous actions:" + NL), hist))


def thought_action_target(thought, action) -> Column:
    """``<think>thought</think>`` line when the thought is non-empty, then the
    stripped action (P11)."""
    t = col_(thought)
    think = F.when(~is_blank(t), F.concat(F.lit("<think>"), t, F.lit("</think>")))
    return F.concat_ws(NL, think, py_strip(F.coalesce(col_(action).cast("string"), F.lit(""))))


def system_prompt(task) -> Column:
    """System prompt by task (P12): grounding or agentic; else null."""
    t = col_(task)
    return (F.when(t == "grounding", F.lit(K.GROUNDING_SYSTEM_PROMPT))
            .when(t == "agentic", F.lit(K.AGENTIC_SYSTEM_PROMPT)))


def preview(response, n: int = 200) -> Column:
    """First ``n`` characters of a response."""
    return F.substring(col_(response), 1, n)
