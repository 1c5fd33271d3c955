"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty

DIMENSIONS = ("source", "lang", "topic")
#: Target shares without explicit ones: proportional to tokens to this power, which lifts small values and holds down large ones.
TEMPER = 0.7
#: Rounds of raking, and rounds between two checkpoints.
ROUNDS, EVERY = 12, 4
#: The value that stands for null in a dimension.
MISSING = "(none)"


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def marker_topic(text_col: str = "text") -> Column:
    """A topic from markers that a text contains; the first that applies."""
    text = text_or_empty(text_col)
    return (
        F.when(text.contains("icense"), "legal").when(text.contains("@"), "contact").when(text.contains("!!"), "loud").when(text.contains("="), "config").otherwise("prose")
    )


def tempered_targets(cells: DataFrame, name: str, temper: float = TEMPER) -> DataFrame:
    """(value, share) of one dimension: its token marginals to the power ``temper``, scaled to sum 1."""
    powers = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("p", F.pow(F.col("t").cast("double"), F.lit(temper)))
    return powers.crossJoin(F.broadcast(powers.agg(F.sum("p").alias("all")))).select("value", (F.col("p") / F.col("all")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``w``: tokens scaled in turn to each dimension's target marginals.

    A value without a target keeps its own total. Each step is a window over one dimension of the table of cells, which has a
    row per combination of values.
    """
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))
    out = cells.where("tokens > 0").crossJoin(F.broadcast(total)).withColumn("w", F.col("tokens").cast("double"))
    for d, target in targets.items():
        out = out.join(target.select(F.col("value").alias(d), F.col("share").alias(f"share_{d}")), d, "left")
        out = out.withColumn(f"goal_{d}", F.coalesce(F.col(f"share_{d}") * F.col("total"), F.sum("w").over(Window.partitionBy(d)))).drop(f"share_{d}")
    for k in range(rounds):
        if k % EVERY == 0:
            out = checkpointed(out)
        for d in targets:
            out = out.withColumn("w", F.col("w") * F.col(f"goal_{d}") / F.sum("w").over(Window.partitionBy(d)))
    return checkpointed(out).select(*targets, "tokens", "w")


def draw(id_col: str = "doc_id") -> Column:
    """A uniform number in [0, 1) that the id alone decides."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, keep: list[str] | None = None,
) -> DataFrame:
    """One row per document: ``doc_id`` (or the columns ``keep``), ``source, lang, topic, tokens, probability, sampled``.

    Token weights are raked to the marginals ``targets`` ({dimension: (value, share)}, tempered ones where missing). A cell's
    factor is its raked weight over its tokens; probabilities are the factors over the largest factor, so none exceeds 1
    and expected tokens meet the targets. The draw is a hash of the id: a rerun samples the same documents. Null dimension values
    count as the value ``(none)``; documents without words weigh nothing and have probability 0; repeated rows are sampled alike; an
    empty table gives an empty result. Column names are resolved to internal ones first, so others may clash.
    """
    columns = keep or [id_col]
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    rows = docs.select(
        *(F.col(c).alias(f"__keep{i}") for i, c in enumerate(columns)), draw(id_col).alias("__u"), value(source_col).alias("source"), value(lang_col).alias("lang"),
        F.coalesce(topic if topic is not None else marker_topic(text_col), F.lit(MISSING)).alias("topic"), word_count(text_col).alias("tokens"),
    )
    cells = checkpointed(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    given = targets or {}
    goals = {d: given[d] if d in given else tempered_targets(cells, d) for d in DIMENSIONS}
    factors = rake(cells, goals, rounds).select(*DIMENSIONS, (F.col("w") / F.col("tokens")).alias("f"))
    largest = factors.agg(F.max("f").alias("top"))
    factors = checkpointed(factors.crossJoin(F.broadcast(largest)).select(*DIMENSIONS, F.round(F.col("f") / F.col("top"), 9).alias("probability")))
    out = rows.join(factors, list(DIMENSIONS), "left")
    chance = F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    return out.select(*(F.col(f"__keep{i}").alias(c) for i, c in enumerate(columns)), *(F.col(d) for d in DIMENSIONS if d not in columns), "tokens", chance.alias("probability"), (F.col("__u") < chance).alias("sampled"))


def mixing_sql(rounds: int = ROUNDS, temper: float = TEMPER) -> str:
    """The same in DuckDB's SQL, over the table ``documents``."""
    steps, last = [], "cells"
    for k in range(rounds):
        for d in DIMENSIONS:
            name = f"w{k}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic, w * goal_{d} / sum(w) OVER (PARTITION BY {d}) AS w FROM {last})")
            last = name
    goals = ", ".join(f"g_{d} AS MATERIALIZED (SELECT {d}, pow(t, {temper}) / (sum(pow(t, {temper})) OVER ()) * (SELECT CAST(sum(tokens) AS DOUBLE) FROM c) AS goal_{d} FROM (SELECT {d}, CAST(sum(tokens) AS DOUBLE) AS t FROM c GROUP BY {d}) WHERE t > 0)" for d in DIMENSIONS)
    return rf"""
WITH r AS (
  SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang,
    CASE WHEN contains(coalesce(text, ''), 'icense') THEN 'legal' WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(coalesce(text, ''), '!!') THEN 'loud' WHEN contains(coalesce(text, ''), '=') THEN 'config' ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY ALL),
{goals},
cells AS MATERIALIZED (SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic, CAST(tokens AS DOUBLE) AS w FROM c JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic) WHERE tokens > 0),
{", ".join(steps)},
p AS MATERIALIZED (SELECT source, lang, topic, round(w / tokens / (SELECT max(w / tokens) FROM {last}), 9) AS probability FROM {last})
SELECT doc_id, source, lang, topic, tokens, CASE WHEN tokens > 0 THEN coalesce(probability, 0.0) ELSE 0.0 END AS probability,
  u < CASE WHEN tokens > 0 THEN coalesce(probability, 0.0) ELSE 0.0 END AS sampled
FROM r LEFT JOIN p USING (source, lang, topic)
"""
