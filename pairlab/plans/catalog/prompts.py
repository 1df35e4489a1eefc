"""Prompt builder queries over the pair dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import prompts as P
from pairlab.plans import fixtures as FX
from pairlab.plans.catalog.base import register, rsql

_SYS = (f"case when language = 'fr' then {P.sql_literal(P.SYSTEM_FR)} "
        f"else {P.sql_fill(P.SYSTEM_DEFAULT, language='language')} end")


@register("instruction_prompt", rsql(f"select article_id, language, {P.sql_fill(P.INSTRUCTION_TEMPLATE, text='text')}"
                                     " as prompt from pairs", "", ("pairs",)))
def instruction_prompt(t):
    return FX.pairs(t).select("article_id", "language", P.instruction_prompt("text").alias("prompt"))


@register("generic_prompt", rsql(f"select article_id, language, "
                                 f"{P.sql_fill(P.GENERIC_TEMPLATE, language='language', text='text')} as prompt "
                                 "from pairs", "", ("pairs",)))
def generic_prompt(t):
    return FX.pairs(t).select("article_id", "language", P.generic_prompt("text", "language").alias("prompt"))


@register("chat_prompt", rsql(f"select article_id, language, "
                              f"concat({P.sql_fill(P.CHAT_TEMPLATE, system=_SYS, text='text')}, summary) as prompt "
                              "from pairs", "", ("pairs",)))
def chat_prompt(t):
    """Training form: system + user + the assistant's answer (the summary)."""
    return FX.pairs(t).select("article_id", "language",
                              P.chat_prompt("text", "language", F.col("summary")).alias("prompt"))


@register("training_prompt", rsql(f"""
select article_id, language,
       case when summary is not null and summary <> '' then concat(prompt, summary) else prompt end as prompt
from (select article_id, language, summary,
             replace(replace(template, '{{language}}', language), '{{text}}', left(text, 4096)) as prompt
      from (select p.article_id, p.language, p.text, p.summary, coalesce(t.template, f.template) as template
            from summaries s0 right join pairs p using (article_id, language)
            left join ({P.sql_values_templates()}) t(tlang, template) on t.tlang = p.language
            left join (select template from ({P.sql_values_templates()}) v(tlang, template) where tlang = '*') f
              on true) x) y""", "", ("pairs", "summaries")))
def training_prompt(t):
    p = P.summary_prompt(FX.pairs(t), P.template_table(t.spark), max_chars=4096)
    return p.select("article_id", "language", P.training_prompt("prompt", "summary").alias("prompt"))
