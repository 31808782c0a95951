"""Features of a prompt and the reply length that a linear model predicts from them, as native columns."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import token_count

#: The model's default weights in tokens, its bounds, and tokens for a unit of requested length: fixed values.
INTERCEPT, LEAST, MOST = 180.0, 16, 8192
WEIGHTS = {
    "prompt_tokens": 0.04,
    "last_user_tokens": 0.35,
    "n_questions": 55.0,
    "has_code_fence": 110.0,
    "asks_for_code": 210.0,
    "asks_for_list": 90.0,
    "asks_brevity": -140.0,
    "asks_detail": 320.0,
    "yes_no_question": -110.0,
    "explicit_length_request": 1.0,
    "json_schema_requested": 40.0,
    "n_messages": 2.0,
    "system_tokens": 0.01,
}
UNITS = {"word": 1.3, "line": 12.0, "paragraph": 80.0, "sentence": 20.0, "bullet": 15.0, "bullet point": 15.0, "item": 15.0}
#: Patterns on the last user message: fixed values.
CODE_VERB = r"(?i)\b(write|implement|create|build|refactor|fix|debug|generate|add|optimi[sz]e)\b"
CODE_NOUN = r"(?i)\b(code|function|class|script|program|method|module|test|bug|api|endpoint|component|regex|quer(?:y|ies)|snippet|algorithm|unit\s+tests?)\b"
LIST = r"(?i)\b(enumerate|list|steps?|bullet(?:\s+points?)?|checklist|itemi[sz]e)\b"
BREVITY = r"(?i)\b(brief(?:ly)?|one\s+word|tl;?dr|short(?:ly)?|concise(?:ly)?|in\s+a\s+(?:word|sentence)|one[- ]liner)\b"
DETAIL = r"(?i)\b(in\s+detail|detailed|comprehensive(?:ly)?|explain\s+thoroughly|thorough(?:ly)?|in[- ]depth|elaborate|extensive(?:ly)?|step[- ]by[- ]step)\b"
YES_NO = r"(?i)^\s*(?:is|are|was|were|am|do|does|did|can|could|will|would|should|shall|has|have|had|must)\b"
LENGTH = r"(?i)\b(\d{1,6})\s*(words?|lines?|paragraphs?|sentences?|bullet\s+points?|bullets?|items?)\b"
JSON = r"(?i)\bjson\s+(?:schema|format|object|only|response|output)\b|\b(?:as|in|valid|return|output|respond\s+(?:in|with)|format(?:ted)?\s+as)\s+json\b"


def explicit_length(text: Column) -> Column:
    """Tokens that the first request for so many words, lines, ... stands for; 0 without one."""
    unit = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(text, LENGTH, 2)), r"\s+", " "), "s$", "")
    worth = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit), F.lit(1.0))
    n = F.regexp_extract(text, LENGTH, 1)
    return F.when(n == "", 0.0).otherwise(n.cast("double") * worth)


def features(full: Column, last_user: Column, system: Column, n_messages: Column) -> dict[str, Column]:
    """The thirteen features of a prompt: its whole text, last user message, system text and number of messages."""
    flag = lambda c: c.cast("double")
    says = lambda pattern, text=last_user: flag(text.rlike(pattern))
    return {
        "prompt_tokens": flag(token_count(full)),
        "last_user_tokens": flag(token_count(last_user)),
        "n_questions": flag(F.regexp_count(last_user, F.lit(r"\?"))),
        "has_code_fence": flag(F.contains(full, F.lit("```"))),
        "asks_for_code": says(CODE_VERB) * says(CODE_NOUN),
        "asks_for_list": says(LIST),
        "asks_brevity": says(BREVITY),
        "asks_detail": says(DETAIL),
        "yes_no_question": says(YES_NO),
        "explicit_length_request": explicit_length(last_user),
        "json_schema_requested": says(JSON, F.concat(last_user, F.lit("\n"), system)),
        "n_messages": flag(n_messages),
        "system_tokens": flag(token_count(system)),
    }


def confidence(f: Mapping[str, Column]) -> Column:
    c = F.lit(0.35) + F.when(f["explicit_length_request"] > 0, 0.5).otherwise(0.0) + 0.15 * f["yes_no_question"]
    c = c + 0.1 * f["asks_brevity"] + 0.05 * f["asks_for_list"] - 0.1 * f["asks_detail"]
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), c))


def prediction(f: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS, intercept: float = INTERCEPT) -> Column:
    """struct<tokens, low, high, confidence>."""
    raw = F.lit(intercept)
    for name, w in weights.items():
        raw = raw + F.lit(float(w)) * f[name]
    n = F.bround(F.least(F.lit(float(MOST)), F.greatest(F.lit(float(LEAST)), raw))).cast("long")
    c = confidence(f)
    spread = 2.0 - c
    low = F.greatest(F.lit(LEAST), F.bround(n / spread).cast("long"))
    high = F.least(F.lit(MOST), F.bround(n * spread).cast("long"))
    return F.struct(n.alias("tokens"), low.cast("long").alias("low"), high.cast("long").alias("high"), c.alias("confidence"))


def max_tokens(tokens: Column, high: Column, safety: float = 1.5, floor: int = 64, cap: int = 16384) -> Column:
    """What to send as a reply's bound."""
    return F.least(F.lit(cap), F.greatest(F.lit(floor), F.ceil(F.greatest(tokens * safety, high.cast("double"))))).cast("long")


def load_weights(path: str) -> dict:
    """{"intercept", "weights"} from a JSON file; ValueError if it isn't such or names an unknown feature."""
    with open(path, encoding="utf-8") as f:
        blob = json.load(f)
    if not isinstance(blob, dict) or not isinstance(blob.get("weights"), dict):
        raise ValueError("weights must be an object with a 'weights' object")
    values = {"intercept": blob.get("intercept", INTERCEPT), **blob["weights"]}
    for name, value in values.items():
        if name != "intercept" and name not in WEIGHTS:
            raise ValueError(f"unknown feature {name!r}")
        if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
            raise ValueError(f"{name} is not a finite number")
    return {"intercept": float(values.pop("intercept")), "weights": {k: float(v) for k, v in values.items()}}


def save_weights(path: str, weights: Mapping[str, float], intercept: float = INTERCEPT) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"intercept": intercept, "weights": dict(weights)}, f, indent=2)
