"""The pluggable scorer: requests out, responses in, retries, repair, replay, and the pipelines around it."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.operators.audit import require_empty, require_no_leak
from knotwork.session import col

#: A scorer takes a request (JSON text) and returns a response (JSON text).
Scorer = Callable[[str], str]


class TransportError(Exception):
    """A failure of the way to the model, worth another try."""


def request(system: str, model: str, visible: Sequence[str], max_tokens: int = 4096) -> Column:
    """A chat request of the visible columns, with fixed sampling parameters."""
    content = F.to_json(F.struct(*(col(c) for c in visible)), {"ignoreNullFields": "false"})
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(
        F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", content)).alias("messages"), F.lit(0).alias("temperature"),
        F.lit(1.0).alias("top_p"), F.lit(max_tokens).alias("max_tokens"), F.struct(F.lit("json_object").alias("type")).alias("response_format"),
    ))


def requests(df: DataFrame, key: str, visible: Sequence[str], forbidden: Sequence[str], system: str, model: str) -> DataFrame:
    """``key, request``, unless a visible column leaks a forbidden field at any depth."""
    require_no_leak(df.select(*(col(c) for c in visible)), forbidden)
    return df.select(col(key).alias("key"), request(system, model, visible).alias("request"))


def response_content(response: Column, schema: str) -> Column:
    """The first choice's content, parsed; null where it does not parse."""
    return F.from_json(F.get_json_object(response, "$.choices[0].message.content"), schema, {"mode": "PERMISSIVE"})


def scored(df: DataFrame, text: str, scorer: Scorer, retries: int = 2, delay_s: float = 0.0, check: Callable[[str], str | None] | None = None) -> DataFrame:
    """``df`` with ``response, attempts, error``: each request scored in the executors, batch by batch.

    Transport errors are tried again up to ``retries`` times. A response that ``check`` finds fault
    with is asked for once more, with the fault added to the request. What still fails has a null
    response and the error; no row is lost. Null requests are not sent.
    """

    def one(body: str | None) -> tuple[str | None, int, str | None]:
        if body is None:
            return None, 0, "no request"
        attempts, failures, fault, repaired = 0, 0, None, False
        while True:
            attempts += 1
            try:
                answer = scorer(body)
            except TransportError as e:
                fault = f"transport: {e}"
                failures += 1
                if failures > retries:
                    return None, attempts, fault
                time.sleep(delay_s)
                continue
            fault = check(answer) if check else None
            if fault is None:
                return answer, attempts, None
            if repaired:
                return None, attempts, f"invalid: {fault}"
            repaired, failures = True, 0
            body = json.dumps({"request": body, "previous": answer, "problem": fault})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [one(x) for x in part[text]]
            yield part.assign(response=[r[0] for r in rows], attempts=[r[1] for r in rows], error=[r[2] for r in rows])

    added = [T.StructField("response", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())]
    return df.mapInPandas(run, T.StructType([*df.schema.fields, *added]))


def replayed(df: DataFrame, key: str, recorded: DataFrame) -> DataFrame:
    """Responses from a recorded table ``key, response`` instead of a model; unknown keys have a null response."""
    one = recorded.select(F.col("key").alias("key_"), "response").groupBy("key_").agg(F.max("response").alias("response"))
    joined = df.join(one, col(key) == F.col("key_"), "left").drop("key_")
    return joined.withColumn("attempts", F.when(F.col("response").isNotNull(), 1).otherwise(0)).withColumn("error", F.when(F.col("response").isNull(), F.lit("not recorded")))


def to_resume(df: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """Rows whose key has not been done yet."""
    return df.join(done.select(col(key).alias(key)).distinct(), key, "left_anti")


def two_stage(pairs: DataFrame, gate: Column, typed: Column, none: str = "NO_RELATION") -> DataFrame:
    """A gate, then a type for the pairs that pass; the others get ``none``."""
    passed = F.coalesce(gate, F.lit(False))
    return pairs.withColumn("gate_passed", passed).withColumn("relation_type", F.when(passed, F.coalesce(typed, F.lit(none))).otherwise(none))


def batches(pairs: DataFrame, key: str, size: int) -> DataFrame:
    """A batch number per row: ``size`` rows in key order each (one row per request with size 1)."""
    from knotwork.operators.pairs import numbered

    return numbered(pairs, [key], "no_").withColumn("batch", F.floor((F.col("no_") - 1) / size).cast("int")).drop("no_")


def rendered(df: DataFrame, templates: Mapping[str, str], kind: str, values: Mapping[str, str], out: str = "text") -> DataFrame:
    """Each row's template by type, ``{name}`` replaced by columns; a type without a template gives null.

    A template is cut at its placeholders once, so what a value holds is never read as a placeholder.
    """
    text = F.lit(None).cast("string")
    for name, template in templates.items():
        parts = [p for p in re.split("(" + "|".join(re.escape("{" + v + "}") for v in values) + ")", template) if p] if values else [template]
        filled = [F.coalesce(col(values[p[1:-1]]).cast("string"), F.lit("")) if p[:1] == "{" and p[1:-1] in values else F.lit(p) for p in parts]
        text = F.when(col(kind) == name, F.concat(*filled) if filled else F.lit("")).otherwise(text)
    return df.withColumn(out, text)


def adjudicated(pending: DataFrame, decisions: DataFrame, key: str, digest: str, recorded_digest: str | None) -> DataFrame:
    """Pending rows with their decision. A decision table for another snapshot, an unused decision or one given twice is an error; without decisions the status is ``draft_pending_adjudication``."""
    if recorded_digest is not None and recorded_digest != digest:
        raise ValueError("the decisions were made for another snapshot")
    unused = decisions.select(key).join(pending.select(key), key, "left_anti")
    require_empty(unused, "decisions without a pending row")
    require_empty(decisions.groupBy(key).count().filter("count > 1"), "rows decided twice")
    joined = pending.join(decisions.select(key, "decision"), key, "left")
    return joined.withColumn("status", F.when(F.col("decision").isNull(), "draft_pending_adjudication").otherwise("final"))
