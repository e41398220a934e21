"""Rules over free text, routing, and the merge of profile patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The warning rules and the request pattern of the source system.
RED_FLAGS = [
    (r"胸(口)?(剧|重|持续)?痛.*(冷汗|呼吸困难)|呼吸困难|心跳非常快.*胸(口)?痛", "疑似严重胸痛伴随症状"),
    (r"意识(不清|丧失)|昏迷|抽搐不止", "意识障碍或持续抽搐"),
    (r"口角歪|一侧.*无力|言语不清|突然.*视物不清", "疑似急性神经系统红旗"),
    (r"大量(呕血|咯血).*头晕", "疑似严重出血"),
    (r"自杀|不想活|伤害自己", "自伤风险"),
]
FORMULA_REQUEST = r"开方|处方|方剂|配药|剂量|几克|怎么煎|怎么服"
# Its message for questions that leave the normal flow, by level.
NO_FLAG = "可能需要紧急评估的症状"
ACTIONS = {"emergency": "请立即联系当地急救服务或尽快前往急诊", "urgent": "请尽快（最好当天）联系医疗机构进行评估；如症状加重，请直接前往急诊"}
URGENT_MESSAGE = ("你描述的情况包含需要优先处理的信号（", "）。", "，不要等待中医辨证或自行用药。如果身边有人，请让对方陪同并准备好当前用药和过敏信息。")
PROTECTED = ("schema_version", "user_id", "updated_at")


def red_flags(question: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """The reasons of the rules that a text matches, in the rules' order."""
    hits = [F.when(F.regexp_like(question, F.lit(p)), F.lit(reason)) for p, reason in rules or RED_FLAGS]
    return F.array_compact(F.array(*hits))


def triage(rows: DataFrame, question: Column, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """flags, level and route; a flagged question leaves the normal flow."""
    out = rows.withColumn("flags", red_flags(F.coalesce(question, F.lit("")), rules))
    stop = F.size("flags") > 0
    return out.withColumns({"level": F.when(stop, "emergency").otherwise("knowledge_only"), "route": F.when(stop, "urgent_message").otherwise("analyse")})


def formula_gate(question: Column, candidates: Column, needed: Column) -> Column:
    """Whether a personal formula is asked for or proposed, and so blocked."""
    asked = F.coalesce(needed, F.lit(False)) | (F.coalesce(F.size(candidates), F.lit(0)) > 0) | F.regexp_like(F.coalesce(question, F.lit("")), F.lit(FORMULA_REQUEST))
    some = lambda *x: F.when(asked, F.array(*map(F.lit, x))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        asked.alias("triggered"),
        F.when(asked, "blocked_for_personal_use").otherwise("not_needed").alias("status"),
        some("historical_formula_education_without_dose").alias("allowed"),
        some("personalized_formula", "dose", "preparation_instructions").alias("blocked"),
    )


def urgent_message(level: Column, flags: Column) -> Column:
    """What a question is answered that leaves the normal flow; null for other levels."""
    reasons = F.array_join(flags, "、")
    told = F.when(F.coalesce(reasons, F.lit("")) != "", reasons).otherwise(NO_FLAG)
    action = F.when(level == "emergency", ACTIONS["emergency"]).when(level == "urgent", ACTIONS["urgent"])
    return F.concat(F.lit(URGENT_MESSAGE[0]), told, F.lit(URGENT_MESSAGE[1]), action, F.lit(URGENT_MESSAGE[2]))


def _patched(old: Column, told: Column) -> Column:
    """A map with the keys of another in place of its own."""
    rest = F.map_filter(old, lambda k, v: ~F.map_contains_key(told, k))
    return F.when(told.isNull() | (F.size(told) == 0), old).when(old.isNull(), told).otherwise(F.map_concat(rest, told))


def merged(base: DataFrame, patch: DataFrame, key: str, fields: list[str], nested: list[str] | None = None) -> DataFrame:
    """Base rows with the patch's non-null values, and the names of the fields that changed.

    Protected fields are never patched; a null changes nothing. Nested fields are maps, of
    which the patch's keys replace the base's one by one; a null value changes nothing there.
    """
    open_ = [f for f in [*fields, *(nested or [])] if f not in PROTECTED and f != key and f in patch.columns]
    p = patch.select(F.col(key), *[F.col(f).alias(f"__{f}") for f in open_])
    rows = base.join(p, key, "left")
    new = {}
    for f in open_:
        if f in (nested or []):
            new[f] = _patched(F.col(f), F.map_filter(F.col(f"__{f}"), lambda k, v: v.isNotNull()))
        else:
            new[f] = F.coalesce(F.col(f"__{f}"), F.col(f))
    plain = lambda f, c: F.array_sort(F.map_entries(c)) if f in (nested or []) else c
    differs = [F.when(~plain(f, c).eqNullSafe(plain(f, F.col(f))), F.lit(f)) for f, c in new.items()]
    out = rows.withColumns({"changed": F.array_compact(F.array(*differs)) if differs else F.array().cast("array<string>"), **{f"__new_{f}": c for f, c in new.items()}})
    return out.withColumns({f: F.col(f"__new_{f}") for f in new}).drop(*[f"__{f}" for f in new], *[f"__new_{f}" for f in new])


def cited(answer: Column, label: str = "S") -> Column:
    """Numbers of the sources that an answer cites as [S1], each once, in order of mention."""
    found = F.regexp_extract_all(answer, F.lit(rf"\[{label}(\d+)\]"), 1)
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def citations(answer: Column, sources: Column, label: str = "S") -> Column:
    """cited, valid, coverage and correctness of the sources that an answer cites.

    valid are the cited numbers from 1 to the number of sources; coverage is their share of
    the sources, correctness their share of what is cited. Nothing to divide by gives null.
    """
    numbers = F.coalesce(cited(answer, label), F.array().cast("array<int>"))
    valid = F.filter(numbers, lambda n: n.between(1, sources))
    share = lambda n: F.round(F.size(valid) / F.nullif(n, F.lit(0)), 6)
    return F.struct(F.size(numbers).alias("cited"), F.size(valid).alias("valid"), share(sources).alias("coverage"), share(F.size(numbers)).alias("correctness"))
