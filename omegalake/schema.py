"""Schemas of the files that benchmarks are kept in; every field may be missing."""

from __future__ import annotations

from pyspark.sql import types as T

#: Text fields of a record that evaluations read.
INPUT_FIELDS = ("natural_paraphrase", "paraphrase_gpt5.4-mini", "paraphrase_gemini-2.5-flash", "paraphrase_deepseek", "paraphrase_claude")


def _fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, k) for n, k in kinds.items()]


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_STRINGS = T.ArrayType(_S)

#: A formula record. ``temporal_behavior`` is a list of tags or one label, so it is read as text.
FORMULA = T.StructType(
    _fields(id=_L, LTL=_S, generated_formula=_S, simplified_formula=_S, ast_size=_I, ast_depth=_I, temporal_depth=_I, num_atomic_props=_I, operator_counts=T.MapType(_S, _I), temporal_behavior=_S)
    + _fields(back_translation=_S, paraphrase=_S, paraphrase_model=_S, formula_size=_I, nesting_depth=_I, proposition_count=_I, operators=_STRINGS)
    + _fields(automaton_num_states=_I, automaton_num_transitions=_I, automaton_size=_I, buchi_size=_I, minimized_buchi_size=_I, is_nnf=_B, origin=_S, source_record_id=_L)
    + [T.StructField(f, _S) for f in INPUT_FIELDS]
)

ENTRY = T.StructType(
    _fields(record_id=_L, id=_L, dataset_id=_L, input_field=_S, field=_S, source_field=_S, source_model=_S, translation_provider=_S, translation_model=_S, prompt_setting=_S, source_text=_S, original_ltl=_S)
    + _fields(predicted_ltl=_S, equivalent=_B, status=_S, error=_S, timestamp=_S, ground_truth_ltl=_S, equivalence_error=_S, raw_model_output=_S, model_output=_S, prediction=_S, generated_ltl=_S)
)

_HEADER = _fields(dataset_path=_S, translation_provider=_S, translation_model=_S, prompt_setting=_S, input_fields=_STRINGS, created_at=_S, updated_at=_S)
ENVELOPE = T.StructType([*_HEADER, T.StructField("results", T.ArrayType(ENTRY))])

CALIBRATION = T.StructType(_fields(ltlequ=_STRINGS, ltlequ_normalized=_STRINGS, ap_mapping=T.ArrayType(T.MapType(_S, _S))))

INSTANCE = T.StructType(_fields(model=_S, ast_size=_I, success=_S, setting=_S))
