"""Understanding a question: intent by ordered rules, scene, emotions, expansion to query strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicon
from scriptorium.functions.text import contains_any, shortened

from .tagging import best_group, groups

VOCABULARY = {
    "commentary": lexicon.COMMENTARY, "analysis": lexicon.ANALYSIS, "first_person": lexicon.FIRST_PERSON, "lookup": lexicon.FACTUAL_LOOKUP,
    "factual": lexicon.FACTUAL, "domain": lexicon.DOMAIN, "out_of_scope": lexicon.OUT_OF_SCOPE,
}


def rule_intent(text: Column, vocabulary: dict[str, list[str]] = VOCABULARY, short: int = 36) -> Column:
    """The first rule that holds: out of scope (and no domain word), commentary, analysis, first person (analysis), look-up keyword,
    factual word in a short question; else analysis."""
    has = {name: contains_any(text, words) for name, words in vocabulary.items()}
    return (
        F.when(has["out_of_scope"] & ~has["domain"], "out_of_scope").when(has["commentary"], "commentary_lookup").when(has["analysis"] | has["first_person"], "analysis")
        .when(has["lookup"], "factual_lookup").when(has["factual"] & (F.length(text) <= short), "factual_lookup").otherwise("analysis")
    )


def resolved_intent(rule: Column, model_intent: Column, confidence: Column, least: float = 0.72) -> Column:
    """The model's intent where it is sure enough, else the rule's; with the kind of decision."""
    sure = model_intent.isNotNull() & (confidence >= least)
    return F.struct(F.when(sure, model_intent).otherwise(rule).alias("intent"), F.when(model_intent.isNull(), "rule").when(sure, "llm").otherwise("rule_fallback").alias("decided_by"))


def expansions(text: Column, table=lexicon.EXPANSIONS, most: int = 3) -> Column:
    """Query strings of the first `most` expansion groups of which a word occurs: the classical words, joined."""
    return F.slice(F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(" ".join(classical))) for words, classical in table])), 1, most)


def rewritten(text: Column, model_lines: Column | None = None, least: int = 4, most: int = 5) -> Column:
    """Query strings: the question, then usable lines of a model, or the expansions."""
    extra = expansions(text)
    if model_lines is not None:
        usable = F.slice(F.filter(model_lines, lambda s: F.length(F.trim(s)) >= least), 1, most)
        extra = F.when(F.size(usable) > 0, usable).otherwise(extra)
    return F.array_distinct(F.concat(F.array(text), extra))


def actors(text: Column, table=lexicon.ACTORS, asker: tuple[str, str, str, str] = lexicon.ASKER, goal: str = lexicon.ACTOR_GOAL, risk: str = lexicon.ACTOR_RISK) -> Column:
    """Array of struct(name, role, goal, risk): the one who asks, then those whose words the question holds."""
    person = lambda name, role, goal, risk: F.struct(F.lit(name).alias("name"), F.lit(role).alias("role"), F.lit(goal).alias("goal"), F.lit(risk).alias("risk"))
    return F.array_compact(F.array(person(*asker), *[F.when(contains_any(text, words), person(name, role, goal, risk)) for name, words, role in table]))


def conflicts(text: Column, scene: Column, table: dict[str, list[str]] = lexicon.CONFLICTS, most: int = 4) -> Column:
    """Conflicts of the scene, and those that words of the question name."""
    listed = F.lit(None).cast("array<string>")
    for name, values in table.items():
        listed = F.when(scene == name, F.array(*[F.lit(v) for v in values])).otherwise(listed)
    listed = F.coalesce(listed, F.array(F.lit("目标不清与关系风险交织")))
    more = F.array_compact(F.array(F.when(text.contains("绕过"), F.lit("沟通链路被绕过")), F.when(text.contains("不信任"), F.lit("关键关系信任不足"))))
    return F.slice(F.array_union(listed, more), 1, most)


def constraints(text: Column) -> Column:
    found = F.array_compact(F.array(
        F.when(contains_any(text, ["不能", "不想"]), F.lit("用户存在明确的行动禁区或顾虑")), F.when(text.contains("离不开"), F.lit("相关角色短期内不可替代")),
        F.when(contains_any(text, ["不知道", "该不该"]), F.lit("当前信息不足，需先验证再决策")),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("信息来自用户单方描述，需要保留假设边界")))


def analyzed(questions: DataFrame, text: str = "text", vocabulary: dict[str, list[str]] = VOCABULARY, scenes=lexicon.SCENES, default_scene: str = "向上管理") -> DataFrame:
    """questions with intent, scene, emotions, conflicts, constraints, summary and queries."""
    t = F.col(text)
    with_scene = questions.withColumns({"intent": rule_intent(t, vocabulary), "scene": best_group(t, scenes, default_scene), "emotions": groups(t, lexicon.EMOTIONS, 6)})
    return with_scene.withColumns({"conflicts": conflicts(t, F.col("scene")), "constraints": constraints(t), "actors": actors(t), "summary": shortened(F.trim(F.replace(t, F.lit("\n"), F.lit(" "))), 90), "queries": rewritten(t)})
