"""The contract of an evaluation configuration, given as one JSON object: every problem in it, named by its path.

Ranges, lists and constants are data; what spans several places (weights that sum to one, ids that are unique, references that resolve,
bounds in order) follows. A configuration is one small object, so this runs where it is read, before any table is touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

LAYERS = ("surface_style", "knowledge_relationship", "value_worldview")
NEAR = 1e-9

#: fixed values: lowest, highest, whether whole
NUMBERS = {
    "surface_style.style_markers.low_seriousness_target_min": (0, 20, True),
    "surface_style.style_markers.target_chars_per_hit": (1, 10000, True),
    "surface_style.style_markers.base_without_marker": (0, 100, False),
    "surface_style.style_markers.seriousness_threshold": (1, 5, False),
    "surface_style.style_markers.serious_scene_allowed_hits": (0, 20, True),
    "surface_style.style_markers.overuse_penalty_per_hit": (0, 100, False),
    "surface_style.style_markers.same_marker_repeat_penalty": (0, 100, False),
    "surface_style.style_markers.density_soft_cap_per_100_chars": (0, 100, False),
    "surface_style.style_markers.density_penalty_per_excess": (0, 100, False),
    "surface_style.register.seriousness_threshold": (1, 5, False),
    "surface_style.register.short_response_chars": (1, 10000, True),
    "surface_style.register.long_response_chars": (1, 100000, True),
    "surface_style.register.ideal_average_sentence_chars.0": (1, 10000, False),
    "surface_style.register.ideal_average_sentence_chars.1": (1, 10000, False),
    "knowledge_relationship.factual_support.ngram_size": (1, 8, True),
    "knowledge_relationship.factual_support.coverage_saturation": (0.000001, 1, False),
    "knowledge_relationship.factual_support.reference_weight": (0, 1, False),
    "knowledge_relationship.factual_support.constraint_weight": (0, 1, False),
    "knowledge_relationship.factual_support.missing_reference_score": (0, 100, False),
    "knowledge_relationship.factual_support.contradiction_penalty": (0, 100, False),
    "knowledge_relationship.factual_support.unresolved_active_constraint_penalty": (0, 100, False),
    "knowledge_relationship.relationship_constraints.missing_expected_penalty": (0, 100, False),
    "knowledge_relationship.relationship_constraints.contradiction_penalty": (0, 100, False),
    "value_worldview.coverage.base_score": (0, 100, False),
    "value_worldview.coverage.principle_weight": (0, 100, False),
    "value_worldview.coverage.action_weight": (0, 100, False),
    "value_worldview.conflict_safety.seriousness_threshold": (1, 5, False),
    "value_worldview.conflict_safety.base_high_risk_score": (0, 100, False),
    "value_worldview.conflict_safety.action_coverage_weight": (0, 100, False),
    "value_worldview.conflict_safety.harmful_term_penalty": (0, 100, False),
}
#: fixed values: what must be just so
CONSTANTS = {
    "score_scales.rule_min": 0, "score_scales.rule_max": 100, "score_scales.judge_min": 1, "score_scales.judge_max": 5, "judge.temperature": 0, "knowledge_relationship.factual_support.reference": "gold_response",
    **{f"score_scales.judge_to_100.{k}": (k - 1) * 25 for k in range(1, 6)},
}
#: Lists of different non-empty words.
WORDS = (
    "surface_style.style_markers.terms", "surface_style.register.colloquial_terms", "surface_style.register.formal_action_terms", "surface_style.register.inappropriate_serious_humor_terms",
    "value_worldview.action_terms", "value_worldview.default_high_risk_actions", "value_worldview.harmful_encouragement_terms",
)
#: Sums: places, and what they add up to.
SUMS = (
    (tuple(f"layers.{layer}.weight" for layer in LAYERS), 1.0),
    (("knowledge_relationship.factual_support.reference_weight", "knowledge_relationship.factual_support.constraint_weight"), 1.0),
    (("value_worldview.coverage.base_score", "value_worldview.coverage.principle_weight", "value_worldview.coverage.action_weight"), 100.0),
    (("value_worldview.conflict_safety.base_high_risk_score", "value_worldview.conflict_safety.action_coverage_weight"), 100.0),
)
#: Pairs of which the first is at most the second.
ORDERED = (
    ("surface_style.register.short_response_chars", "surface_style.register.long_response_chars"),
    ("surface_style.register.ideal_average_sentence_chars.0", "surface_style.register.ideal_average_sentence_chars.1"),
)
#: Lists of objects with ids, and the word lists of each (True: may be empty).
OBJECTS = {
    "knowledge_relationship.relationship_constraints.facts": {"triggers": False, "supported_terms": False, "negated_supported_patterns": True, "contradiction_terms": False},
    "value_worldview.risk_action_groups": {"triggers": False, "actions": False},
}


@dataclass(frozen=True)
class Missing:
    """Stands for what is not there."""


def at(value, path: str):
    """What is at a path of names and positions."""
    for name in path.split("."):
        if isinstance(value, dict) and name in value:
            value = value[name]
        elif isinstance(value, list) and name.isdigit() and int(name) < len(value):
            value = value[int(name)]
        else:
            return Missing()
    return value


def number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


def wordless(value, empty: bool = False) -> str | None:
    """What is wrong with a list of words."""
    if not isinstance(value, list) or not (value or empty):
        return "is no list of words" if not isinstance(value, list) else "is empty"
    if not all(isinstance(w, str) and w and w == w.strip() for w in value):
        return "has a word that is blank or has space around it"
    return "has a word twice" if len(set(value)) < len(value) else None


def problems(config) -> Iterator[str]:
    """Every problem as `path: what`; none where the configuration keeps its contract."""
    if not isinstance(config, dict):
        yield "$: is no object"
        return
    for path, (low, high, whole) in NUMBERS.items():
        v = at(config, path)
        if not number(v) or not low <= v <= high or whole and not isinstance(v, int):
            yield f"{path}: must be a{' whole' * whole} number from {low} to {high}"
    for path, want in CONSTANTS.items():
        v = at(config, path)
        if type(v) is not type(want) or v != want:
            yield f"{path}: must be {want!r}"
    for path in WORDS:
        if bad := wordless(at(config, path)):
            yield f"{path}: {bad}"
    for path, lists in OBJECTS.items():
        yield from _objects(at(config, path), path, lists)
    yield from _principles(config)
    yield from _layers(config)
    yield from _judge(config)
    for places, total in SUMS:
        values = [at(config, p) for p in places]
        if all(map(number, values)) and abs(sum(values) - total) > NEAR:
            yield f"{', '.join(places)}: must sum to {total:g}"
    for low, high in ORDERED:
        a, b = at(config, low), at(config, high)
        if number(a) and number(b) and a > b:
            yield f"{low}: is greater than {high}"


def _objects(value, path: str, lists: dict[str, bool]) -> Iterator[str]:
    if not isinstance(value, list) or not value:
        yield f"{path}: is no list of objects"
        return
    seen = set()
    for i, item in enumerate(value):
        name = at(item, "id")
        if not isinstance(name, str) or not name.strip():
            yield f"{path}.{i}.id: is blank"
        elif name in seen:
            yield f"{path}.{i}.id: {name} is there twice"
        else:
            seen.add(name)
        for field, empty in lists.items():
            if bad := wordless(at(item, field), empty):
                yield f"{path}.{i}.{field}: {bad}"


def _principles(config: dict) -> Iterator[str]:
    known, by = at(config, "value_worldview.principles"), at(config, "value_worldview.principles_by_capability")
    for path, value in (("value_worldview.principles", known), ("value_worldview.principles_by_capability", by)):
        if not isinstance(value, dict) or not value:
            yield f"{path}: is no object with entries"
            continue
        for name, words in value.items():
            if bad := "has a blank name" if not name.strip() else wordless(words):
                yield f"{path}.{name}: {bad}"
            elif value is by and isinstance(known, dict) and (unknown := sorted(set(words) - set(known))):
                yield f"{path}.{name}: refers to {', '.join(unknown)}, which is not there"


def _layers(config: dict) -> Iterator[str]:
    layers = at(config, "layers")
    if not isinstance(layers, dict) or set(layers) != set(LAYERS):
        yield f"layers: must be {', '.join(LAYERS)}"
        return
    for name, layer in layers.items():
        if not number(w := at(layer, "weight")) or w < 0:
            yield f"layers.{name}.weight: must be a number, not negative"
        metrics = at(layer, "metrics")
        weights = [at(m, "weight") for m in metrics.values()] if isinstance(metrics, dict) else []
        if not weights or not all(number(w) and w >= 0 for w in weights):
            yield f"layers.{name}.metrics: must have weights, none of them negative"
        elif abs(sum(weights) - 1) > NEAR:
            yield f"layers.{name}.metrics: must sum to 1"


def _judge(config: dict) -> Iterator[str]:
    judge = at(config, "judge")
    for field in ("default_seed", "max_tokens"):
        v = at(judge, field)
        if not isinstance(v, int) or isinstance(v, bool) or field == "max_tokens" and v < 1:
            yield f"judge.{field}: must be a {'positive ' * (field == 'max_tokens')}whole number"
    for field in ("provider", "model", "base_url", "thinking", "seed_scope"):
        v = at(judge, field)
        if not isinstance(v, str) or not v.strip():
            yield f"judge.{field}: is blank"
    fields = at(judge, "required_fields_per_candidate_layer")
    if not isinstance(fields, list) or sorted(map(str, fields)) != ["evidence", "reason", "score"]:
        yield "judge.required_fields_per_candidate_layer: must be score, reason and evidence"


def tokenizer_problems(identity) -> Iterator[str]:
    """What is wrong with a tokenizer's identity: all fields there and of their types; only the begin token may be null."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0
    text = lambda v: isinstance(v, str) and bool(v)
    rules = {
        "chat_template_sha256": (text, "a hash"), "bos_token_id": (lambda v: v is None or whole(v), "a token or null"), "eos_token_id": (whole, "a token"), "pad_token_id": (whole, "a token"),
        "padding_side": (lambda v: v in ("left", "right"), "left or right"), "chat_template_kwargs": (lambda v: isinstance(v, dict), "an object"),
    }
    if not isinstance(identity, dict):
        yield "$: is no object"
        return
    for field, (test, what) in rules.items():
        if field not in identity:
            yield f"{field}: is missing"
        elif not test(identity[field]):
            yield f"{field}: must be {what}"
