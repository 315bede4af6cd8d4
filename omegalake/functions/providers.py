"""Answers of model providers: the text in their response JSON, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXTS = "array<struct<type:string,text:string>>"


def _texts(parts: Column) -> Column:
    """The texts of parts, joined; null without any."""
    found = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull())
    return F.when(F.size(found) > 0, F.trim(F.array_join(found, "")))


def _field(response: Column, schema: str) -> Column:
    return F.from_json(response, f"struct<{schema}>")


def openai(response: Column) -> Column:
    """``output_text``, else the texts of ``output[].content[]``."""
    r = _field(response, f"output_text:string,output:array<struct<content:{_TEXTS}>>")
    parts = F.flatten(F.transform(r["output"], lambda o: F.coalesce(o["content"], F.array().cast(_TEXTS))))
    return F.coalesce(F.when(F.trim(r["output_text"]) != "", F.trim(r["output_text"])), _texts(parts))


def gemini(response: Column) -> Column:
    r = _field(response, f"candidates:array<struct<content:struct<parts:{_TEXTS}>>>")
    return _texts(F.get(r["candidates"], F.lit(0))["content"]["parts"])


def anthropic(response: Column) -> Column:
    return _texts(_field(response, f"content:{_TEXTS}")["content"])


def chat(response: Column) -> Column:
    """``choices[0].message.content``, a text or a list of parts with texts."""
    content = F.get(_field(response, "choices:array<struct<message:struct<content:string>>>")["choices"], F.lit(0))["message"]["content"]
    listed = F.ltrim(content).startswith("[")
    return F.when(listed, _texts(F.from_json(F.when(listed, content), _TEXTS))).otherwise(F.trim(content))


#: Providers and where their answers stand.
EXTRACTORS = {"openai": openai, "gemini": gemini, "anthropic": anthropic, "deepseek": chat, "mistral": chat}


def answer(provider: Column, response: Column) -> Column:
    """The answer of any known provider; null for others."""
    found = F.lit(None).cast("string")
    for name, extract in EXTRACTORS.items():
        found = F.when(F.lower(provider) == name, extract(response)).otherwise(found)
    return found
