"""Row types of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EXTRACTION = _struct(value=_S, status=_S, strategy=_S, evidence=_S)
RESPONSE = _struct(text=_S, finish_reason=_S, prompt_tokens=_I, completion_tokens=_I, latency_s=_D, error=_S)
CONSTRAINT = _struct(id=_S, outcome=_S, reason=_S, strict=T.BooleanType(), loose=T.BooleanType())
RECORD = _struct(
    item_id=_S, prompt=_S, response=_S, status=_S, extracted=_S, gold=_S, score=_D, strategy=_S, evidence=_S, meta=T.MapType(_S, _S), finish_reason=_S,
    prompt_tokens=_I, completion_tokens=_I, latency_s=_D, error=_S,
)
ITEM = _struct(item_id=_S, ord=T.LongType(), payload=T.MapType(_S, _S), gold=_S, meta=T.MapType(_S, _S))
METRICS = _struct(primary=_D, ci_low=_D, ci_high=_D)
DIAGNOSTICS = _struct(coverage=_D, unparsed_rate=_D, truncated_rate=_D, error_rate=_D, at_or_below_chance=T.BooleanType())
TASK_RESULT = _struct(task_version=_S, dataset=_S, dataset_sha256=_S, n_items=T.LongType(), n_scored=T.LongType(), metrics=METRICS, diagnostics=DIAGNOSTICS, reasoning=_S, error=_S)
MANIFEST = _struct(
    run_id=_S, model=_S, provider=_S, organization=_S, license=_S, weights_url=_S, quantization=_S, temperature=_D, reasoning=_S, harness_version=_S, harness_git_sha=_S,
    started_at=_S, finished_at=_S, tasks=T.MapType(_S, TASK_RESULT),
)
SUBMISSION = _struct(id=_S, created_at=T.TimestampType(), name=_S, email=_S, model_name=_S, company=_S, notes=_S, ip_hash=_S)
STATUSES = ("ok", "unparsed", "truncated", "error", "refusal")
