"""Prompt builders: pure string projections over columns.

Templates live in a small table (one row per language and variant) that is
joined with a broadcast (its size is bounded by the hand-written template
list).  ``{language}`` is substituted before ``{text}`` so article text is
never re-scanned for placeholders.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ColLike = Column | str


def _c(x: ColLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# Prompt texts that must equal the reference's (whitespace is
# significant).  Summary-generation templates per language; the "evaluate"
# variant differs only in the indentation of the German last line.
# ---------------------------------------------------------------------------
SUMMARY_TEMPLATES = {
    "en": """Please provide a concise summary of the following article in English. 
        The summary should be comprehensive, capturing all key points and main arguments, 
        but avoid unnecessary details. Output only the summary.

        Article:
        {text}

        Summary:""",
    "fr": """Veuillez fournir un résumé concis de l'article suivant en français. 
        Le résumé doit être complet, capturant tous les points clés et les arguments principaux, 
        mais évitant les détails inutiles. Ne produisez que le résumé.

        Article:
        {text}

        Résumé:""",
    "de": """Bitte erstellen Sie eine prägnante Zusammenfassung des folgenden Artikels auf Deutsch. 
        Die Zusammenfassung sollte umfassend sein, alle Hauptpunkte und Hauptargumente erfassen, 
        aber unnötige Details vermeiden. Geben Sie nur die Zusammenfassung aus.

        Artikel:
        {text}

Zusammenfassung:""",
    "ja": """以下の記事を日本語で簡潔に要約してください。
        要約は包括的であり、すべての重要なポイントと主な議論を捉える必要がありますが、
        不必要な詳細は避けてください。要約のみを出力してください。

        記事:
        {text}

        要約:""",
    "ru": """Пожалуйста, предоставьте краткое изложение следующей статьи на русском языке. 
        Резюме должно быть всеобъемлющим, охватывающим все ключевые моменты и основные аргументы, 
        но избегающим ненужных деталей. Выводите только резюме.

        Статья:
        {text}

        Резюме:""",
    "*": """Please provide a concise summary of the following article in {language}. 
        The summary should be comprehensive, capturing all key points and main arguments, 
        but avoid unnecessary details. Output only the summary.

        Article:
        {text}

        Summary:""",
}
SUMMARY_TEMPLATE_DE_EVALUATE = """Bitte erstellen Sie eine prägnante Zusammenfassung des folgenden Artikels auf Deutsch. 
        Die Zusammenfassung sollte umfassend sein, alle Hauptpunkte und Hauptargumente erfassen, 
        aber unnötige Details vermeiden. Geben Sie nur die Zusammenfassung aus.

        Artikel:
        {text}

        Zusammenfassung:"""

GENERIC_TEMPLATE = """Please provide a concise summary of the following article in {language}. 
The summary should be comprehensive, capturing all key points and main arguments, 
but avoid unnecessary details.

Article:
{text}

Summary:"""

INSTRUCTION_TEMPLATE = """### Instruction:
Summarize the following text in a concise manner.

### Input:
{text}

### Response:
"""

SYSTEM_FR = """Vous êtes un expert en résumé. Votre tâche est de créer des résumés concis et complets 
qui capturent tous les points clés et les arguments principaux tout en évitant les détails inutiles. 
Ne copiez pas simplement les premières phrases de l'article. Créez un résumé qui se tient 
par lui-même et couvre tout le contenu important de l'article."""
SYSTEM_DEFAULT = """You are an expert summarizer. Your task is to create concise, comprehensive summaries 
in {language} that capture all key points and main arguments while avoiding unnecessary details. 
Do not simply copy the first few sentences of the article. Create a summary that stands 
on its own and covers the entire article's important content."""
CHAT_TEMPLATE = "<|system|>{system}<|end|><|user|>Please summarize the following article: {text}<|end|><|assistant|>"

JUDGE_SYSTEM = "You are an expert evaluator of text summaries."
JUDGE_TEMPLATE = """Your task is to evaluate the quality of two different summaries for the topic: "{title}".

Reference summary: {reference}

Summary A: {summary_a}

Summary B: {summary_b}

Evaluate both summaries on a scale from 1 to 5, where:
- 1 represents the worst possible summary (completely incorrect, misleading, or irrelevant)
- 3 represents an average summary with some good aspects but some issues
- 5 represents a perfect summary (accurate, comprehensive, concise, and well-written)

You should think, reason and Compare the summaries based on:
1. Factual accuracy relative to the reference, 2. Completeness of information, 3. Clarity and readability, 4. Conciseness. Make sure to give different scores for both summaries.

Provide your evaluation in this exact JSON format:
{
  "score_a": integer from 1 to 5,
  "score_b": integer from 1 to 5,
  "explanation": "A brief explanation of your scores"
}

Make sure to use only whole numbers (1, 2, 3, 4, or 5) for your scores, not decimals.
"""
# ---------------------------------------------------------------------------


def template_rows(variant: str = "generate") -> list[tuple[str, str, str]]:
    rows = []
    for lang, tpl in SUMMARY_TEMPLATES.items():
        if variant == "evaluate" and lang == "de":
            tpl = SUMMARY_TEMPLATE_DE_EVALUATE
        rows.append((lang, variant, tpl))
    return rows


def template_table(spark: SparkSession, variant: str = "generate") -> DataFrame:
    """(language, variant, template); language ``*`` is the fallback."""
    return spark.createDataFrame(template_rows(variant), "language string, variant string, template string")


_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill(template: str | Column, **values: Column) -> Column:
    """Substitute ``{name}`` placeholders.

    A fixed (Python) template is cut at its placeholders once and rebuilt
    with ``concat`` -- one pass, values are never re-scanned.  A template
    held in a column is filled with ``replace``; ``text`` goes last so the
    article body is never searched for placeholders.
    """
    if isinstance(template, str):
        parts = _PLACEHOLDER.split(template)
        return F.concat(*[F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts) if p != "" or i % 2])
    out = template
    for n in sorted(values, key=lambda n: n == "text"):
        out = F.replace(out, F.lit("{" + n + "}"), values[n])
    return out


def sql_fill(template: str, **exprs: str) -> str:
    """The same fixed template as an SQL ``concat`` (oracle side)."""
    parts = _PLACEHOLDER.split(template)
    return "concat(" + ", ".join(sql_literal(p) if i % 2 == 0 else exprs[p]
                                 for i, p in enumerate(parts) if p != "" or i % 2) + ")"


def summary_prompt(df: DataFrame, templates: DataFrame, text: str = "text", language: str = "language",
                   max_chars: int = 4096, out: str = "prompt") -> DataFrame:
    """Language template + text cut to ``max_chars`` characters (model input limit)."""
    from pairlab.operators.corpus import prompt_template_join
    j = prompt_template_join(df, templates.select("language", "template"), language, fallback="*")
    return j.withColumn(out, fill(F.col("template"), language=F.col(language),
                                  text=F.left(F.col(text), F.lit(max_chars)))).drop("template")


def training_prompt(prompt: ColLike, summary: ColLike) -> Column:
    """prompt + summary when the summary is non-empty."""
    s = _c(summary)
    return F.when(s.isNotNull() & (s != ""), F.concat(_c(prompt), s)).otherwise(_c(prompt))


def generic_prompt(text: ColLike, language: ColLike) -> Column:
    return fill(GENERIC_TEMPLATE, language=_c(language), text=_c(text))


def instruction_prompt(text: ColLike) -> Column:
    return fill(INSTRUCTION_TEMPLATE, text=_c(text))


def system_message(language: ColLike) -> Column:
    lang = _c(language)
    return F.when(lang == "fr", F.lit(SYSTEM_FR)).otherwise(fill(SYSTEM_DEFAULT, language=lang))


def chat_prompt(text: ColLike, language: ColLike, summary: ColLike | None = None) -> Column:
    """system + user (+ assistant answer when ``summary`` is given)."""
    p = fill(CHAT_TEMPLATE, system=system_message(language), text=_c(text))
    return F.concat(p, _c(summary)) if summary is not None else p


def judge_prompt(title: ColLike, reference: ColLike, a: ColLike, b: ColLike) -> Column:
    return fill(JUDGE_TEMPLATE, title=_c(title), reference=_c(reference),
                summary_a=_c(a), summary_b=_c(b))


def judge_messages(title: ColLike, reference: ColLike, a: ColLike, b: ColLike) -> Column:
    """Chat messages array<struct<role, content array<struct<type, text>>>>."""
    def msg(role, txt):
        return F.struct(F.lit(role).alias("role"),
                        F.array(F.struct(F.lit("text").alias("type"), txt.alias("text"))).alias("content"))
    return F.array(msg("system", F.lit(JUDGE_SYSTEM)), msg("user", judge_prompt(title, reference, a, b)))


def sql_literal(s: str) -> str:
    """A string as an SQL literal (for the oracle side)."""
    return "'" + s.replace("'", "''") + "'"


def sql_values_templates(variant: str = "generate") -> str:
    """The template table as an SQL VALUES list (oracle side)."""
    return "values " + ", ".join(f"({sql_literal(l)}, {sql_literal(t)})" for l, _, t in template_rows(variant))
