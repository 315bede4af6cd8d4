"""Names of models, prompt settings and text fields of result files, by rules in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File stems of runs and their models.
RUNS = (("GPT54_fewshot", "gpt-5.4"), ("GPT55_fewshot", "gpt-5.5"), ("Claude_fewshot", "claude-opus-4-7"), ("DeepSeek_fewshot", "deepseek-v4-flash"), ("Mistral_fewshot", "mistral-medium-latest"))
#: Parts of model names and the models they stand for, in order of precedence.
FAMILIES = (("deepseek", "deepseek-v4-flash"), ("claude", "claude-opus-4-7"), ("mistral", "mistral-medium-latest"))
#: Spellings of two models: as a whole name, and within one.
VERSIONS = (("gpt-5.4", ("gpt54", "gpt-5.4", "gpt5.4"), ("gpt54_fewshot", "gpt5.4")), ("gpt-5.5", ("gpt55", "gpt-5.5", "gpt5.5"), ("gpt55_fewshot", "gpt5.5")))
#: Text fields, their labels in reports, and the models that wrote them.
FIELDS = (
    ("natural_paraphrase", "natural", "unknown"),
    ("paraphrase_gpt5.4-mini", "gpt-5.4-mini", "gpt-5.4-mini"),
    ("paraphrase_gemini-2.5-flash", "gemini-2.5-flash", "gemini-2.5-flash"),
    ("paraphrase_deepseek", "deepseek-v4-flash", "deepseek"),
    ("paraphrase_claude", "claude", "unknown"),
)
FINE_TUNED = "finetuned-t5"
_FINE_TUNED_NAME = r"^t5$|^t5_|_t5$|_t5_|finetuned-t5"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def _cases(pairs: list[tuple[Column, Column]], last: Column) -> Column:
    found = last
    for test, value in reversed(pairs):
        found = F.when(test, value).otherwise(found)
    return found


def model_name(header: Column, path: Column) -> Column:
    """The model of a result file: by its stem, else by the header's name (the stem, if there is none)."""
    own = stem(path)
    name = F.coalesce(header, own)
    low = F.lower(name)
    rules = [(F.lower(own).rlike(_FINE_TUNED_NAME), F.lit(FINE_TUNED))]
    rules += [(own == run, F.lit(model)) for run, model in RUNS]
    rules += [(low.contains(part), F.lit(model)) for part, model in FAMILIES]
    for model, whole, within in VERSIONS:
        test = low.isin(*whole)
        for part in within:
            test = test | low.contains(part)
        rules.append((test, F.lit(model)))
    rules.append((low.rlike(_FINE_TUNED_NAME), F.lit(FINE_TUNED)))
    return _cases([(F.coalesce(t, F.lit(False)), v) for t, v in rules], name)


def prompt_setting(header: Column, path: Column) -> Column:
    low = F.lower(F.substring_index(path, "/", -1))
    return F.coalesce(F.lower(header), F.when(low.contains("fewshot") | low.contains("few_shot"), "fewshot").otherwise("zeroshot"))


def provider(header: Column) -> Column:
    return F.coalesce(header, F.lit("unknown"))


def field_label(field: Column) -> Column:
    return _cases([(field == f, F.lit(label)) for f, label, _ in FIELDS], field)


def field_model(field: Column) -> Column:
    return _cases([(field == f, F.lit(model)) for f, _, model in FIELDS], F.lit("unknown"))


def ignores_errors(model: Column, path: Column) -> Column:
    """Whether failed rows stay out of the denominator of a file's rates."""
    own = stem(path)
    return (model == FINE_TUNED) | (own == "NL2TL") | F.lower(own).contains("t5")
