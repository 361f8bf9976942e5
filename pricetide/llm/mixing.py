"""Mixing sources to target weights by iterative proportional fitting. DataFrame operations only.

Documents fall into cells by source, language and topic. The sample is to hold KEEP of all
tokens, shared out among sources, languages and topics as their targets say. A cell's quota starts
as its tokens and is raked in turn to the targets of sources, languages and topics, ROUNDS times.
Nothing can give more than it has: a value with too few tokens for its target gives all, and the
others share the rest as their targets say (found in FILLS steps); a cell's quota stays at its tokens,
and what its value still lacks is raised from other cells. A document's probability is its cell's quota by
its tokens; it is taken if a number drawn from its doc_id by hash is below that. So the sample
doesn't depend on partitions, and other documents of a cell don't change who is drawn first.
`residual` tells for each document by how much the expected share of its source, language or topic
misses the target at most: it is not 0 where a value has too few tokens for its target.

The steps are windows over the cells, one plan without joins, so the driver has no tables to build and hand out:
a task sees the cells of one value at a time (not its documents), and what doesn't fit in memory is spilled.

Targets are tables (value, share); those left out are the present shares to the power
given in TEMPER, which moves weight from large groups to small ones. Values without a
target keep no weight; targets of values that don't occur are not met, and the sample is less by them.

Tokens are stretches without white space, counted over whole texts. The topic is the
column `topic` if the table has one, else the register of the text (REGISTER). Null
sources, languages and topics are the value "". A null doc_id is drawn by the text. Empty
texts weigh nothing and are taken. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chosen, staged

ROUNDS, FILLS, KEEP = 6, 4, 0.8
#: Quotas as near as this to all tokens of a cell are all of them, in whatever order sums were made.
FULL = 1 - 1e-12
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.8}
TOKEN = r"[^ \t\r\n]+"
REGISTER = """case when 20 * marks > n_tokens then 'markup' when 20 * digits > n_tokens then 'numeric'
     when n_tokens < 100 then 'note' when n_tokens < 1000 then 'article' else 'book' end"""
DRAWN = 1 << 52


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, a hash of the text and the number drawn for each document."""
    text = F.coalesce("text", F.lit(""))
    known = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else F.expr(REGISTER)
    rows = docs.select("doc_id", "source", "lang", *(["topic"] if "topic" in docs.columns else []), text.alias("_text"))
    counted = rows.withColumns({"n_tokens": F.regexp_count("_text", F.lit(TOKEN)).cast("long"), "digits": F.regexp_count("_text", F.lit("[0-9]")), "marks": F.regexp_count("_text", F.lit("[#$%&*]"))})
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("_text"))), 1, 13), 16, 10).cast("long")
    return counted.select("doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")), known.alias("topic"), "n_tokens", F.xxhash64("_text").alias("raw"), (number / F.lit(DRAWN)).alias("drawn"))


def raked(cells: DataFrame, targets: Mapping[str, DataFrame] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with `quota`, the tokens to take of each, and the highest `residual` of its values."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    out = cells.withColumn("quota", F.col("tokens") * F.lit(keep))
    for by, power in TEMPER.items():
        sums = cells.groupBy(by).agg(F.sum("tokens").alias("tokens"))
        if targets and by in targets:
            wanted = targets[by].groupBy(F.col("value").alias(by)).agg(F.sum("share").alias("share"))
            sums = sums.join(wanted.hint("merge"), by, "left").fillna(0.0, ["share"])
        else:
            sums = sums.withColumn("share", F.pow(F.col("tokens") / F.lit(total), F.lit(power)))
        sums = staged(sums)
        every = sums.agg(F.sum("share")).first()[0] or 1.0
        sums, rate = sums.withColumn("share", F.col("share") / F.lit(every)), total * keep
        for _ in range(FILLS):
            most = F.col("share") * F.lit(rate) >= F.col("tokens")
            full, free = sums.agg(F.sum(F.when(most, F.col("tokens")).otherwise(0)), F.sum(F.when(most, 0.0).otherwise(F.col("share")))).first()
            rate = (total * keep - full) / free if free else rate
        goal = sums.select(by, (F.col("share") * F.lit(total * keep)).alias(f"target_{by}"), F.least(F.col("tokens").cast("double"), F.col("share") * F.lit(rate)).alias(f"goal_{by}"))
        out = out.join(goal.hint("merge"), by)
    for _ in range(rounds):
        for by in TEMPER:
            out = _moved(out, by, f"goal_{by}")
    misses = (F.abs((F.sum("quota").over(Window.partitionBy(by)) - F.col(f"target_{by}")) / F.lit(total * keep or 1.0)).alias(f"_{by}") for by in TEMPER)
    return staged(out.select("*", *misses).select("source", "lang", "topic", "tokens", "quota", F.greatest(*(f"_{by}" for by in TEMPER)).alias("residual")))


def _bounded(cells: DataFrame, goal: DataFrame, by: str) -> DataFrame:
    return _moved(cells.join(goal, by), by, "goal").select("source", "lang", "topic", "tokens", "quota")


def _moved(cells: DataFrame, by: str, goal: str) -> DataFrame:
    """Quotas of each value's cells that aren't full are raised or lowered to its goal; if even the full ones are too much, all are lowered."""
    value = Window.partitionBy(by)
    full = F.col("quota") >= F.col("tokens") * F.lit(FULL)
    sums = cells.withColumns({"_full": F.sum(F.when(full, F.col("quota")).otherwise(0.0)).over(value), "_free": F.sum(F.when(full, 0.0).otherwise(F.col("quota"))).over(value)})
    part = F.expr(f"_free > 0 and {goal} > _full")
    rate = F.when(part, F.expr(f"({goal} - _full) / _free")).otherwise(F.expr(f"{goal} / nullif(_full + _free, 0.0D)"))
    moved = F.when(part & full, F.col("quota")).otherwise(F.col("quota") * F.coalesce(rate, F.lit(0.0)))
    return sums.withColumn("quota", F.least(moved, F.col("tokens").cast("double"))).drop("_full", "_free")


def filtered(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of `docs`, all columns, that the sample takes."""
    return chosen(docs, _decided(docs, targets, keep, ROUNDS).where("kept").select("doc_id", "raw"), once=False)


def mix(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """One row a document: doc_id, source, lang, topic, n_tokens, weight (its cell's share of the sample's tokens), probability, residual, kept."""
    return _decided(docs, targets, keep, rounds).drop("raw")


def _decided(docs: DataFrame, targets: Mapping[str, DataFrame] | None, keep: float, rounds: int) -> DataFrame:
    rows = staged(sized(docs))
    cells = staged(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    quotas = raked(cells, targets, keep, rounds)
    every = quotas.agg(F.sum("quota")).first()[0] or 1.0
    rated = quotas.select("source", "lang", "topic", (F.col("quota") / F.lit(every)).alias("weight"), (F.col("quota") / F.col("tokens")).alias("probability"), "residual")
    out = rows.join(rated, ["source", "lang", "topic"], "left")
    chance = F.coalesce("probability", F.lit(1.0))
    return out.select("doc_id", "raw", "source", "lang", "topic", "n_tokens", F.round(F.coalesce("weight", F.lit(0.0)), 9).alias("weight"), F.round(chance, 9).alias("probability"), F.round(F.coalesce("residual", F.lit(0.0)), 9).alias("residual"), (F.col("drawn") < chance).alias("kept"))


def oracle() -> str:
    """The same in SQL: one step of raking after another."""
    parts = [
        rf"""sized as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, drawn, n_tokens, {REGISTER} as topic from (
          select doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) as n_tokens, len(regexp_extract_all(coalesce(text, ''), '[0-9]')) as digits, len(regexp_extract_all(coalesce(text, ''), '[#$%&*]')) as marks,
          cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), text, '')), 1, 13) as bigint) / {DRAWN}.0 as drawn from documents))""",
        "cells as (select source, lang, topic, cast(sum(n_tokens) as bigint) as tokens from sized group by all having sum(n_tokens) > 0)",
        f"shares as (select *, {KEEP} * sum(tokens) over () as sample, " + ", ".join(f"sum(tokens) over (partition by {by}) as t_{by}, pow(sum(tokens) over (partition by {by}) / sum(tokens) over (), {p}) as s_{by}, tokens / sum(tokens) over (partition by {by}) as p_{by}" for by, p in TEMPER.items()) + " from cells)",
        "fill0 as (select *, " + ", ".join(f"s_{by} / sum(s_{by} * p_{by}) over () as n_{by}, sample as l_{by}" for by in TEMPER) + " from shares)",
    ]
    for i in range(FILLS):
        rate = ", ".join(f"coalesce((sample - sum(case when n_{by} * l_{by} >= t_{by} then t_{by} * p_{by} else 0 end) over ()) / nullif(sum(case when n_{by} * l_{by} >= t_{by} then 0 else n_{by} * p_{by} end) over (), 0.0), l_{by}) as l_{by}" for by in TEMPER)
        parts.append(f"fill{i + 1} as (select * exclude ({', '.join('l_' + by for by in TEMPER)}), {rate} from fill{i})")
    parts += [
        f"step0 as (select source, lang, topic, tokens, sample, tokens * {KEEP} as quota, " + ", ".join(f"n_{by} * sample as w_{by}, least(cast(t_{by} as double), n_{by} * l_{by}) as g_{by}" for by in TEMPER) + f" from fill{FILLS})",
    ]
    n = 0
    for _ in range(ROUNDS):
        for by in TEMPER:
            parts.append(f"sums{n} as (select *, sum(case when quota >= tokens then quota else 0 end) over (partition by {by}) as s_full, sum(case when quota >= tokens then 0 else quota end) over (partition by {by}) as s_free from step{n})")
            parts.append(f"""step{n + 1} as (select source, lang, topic, tokens, sample, {', '.join(f'w_{b}, g_{b}' for b in TEMPER)}, least(case when s_free > 0 and g_{by} > s_full
              then case when quota >= tokens then quota else quota * ((g_{by} - s_full) / s_free) end else quota * coalesce(g_{by} / nullif(s_full + s_free, 0.0), 0.0) end, cast(tokens as double)) as quota from sums{n})""")
            n += 1
    misses = ", ".join(f"abs((sum(quota) over (partition by {by}) - w_{by}) / sample)" for by in TEMPER)
    parts.append(f"final as (select source, lang, topic, quota / sum(quota) over () as weight, quota / tokens as probability, greatest({misses}) as residual from step{n})")
    return "with " + ",\n".join(parts) + """
    select doc_id, source, lang, topic, cast(n_tokens as bigint) as n_tokens, round(coalesce(weight, 0), 9) as weight, round(coalesce(probability, 1.0), 9) as probability, round(coalesce(residual, 0.0), 9) as residual, drawn < coalesce(probability, 1.0) as kept
    from sized left join final using (source, lang, topic)"""
