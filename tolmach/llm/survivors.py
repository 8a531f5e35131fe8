"""One surviving record per group of records, put together field by field.

What each kind of source is worth is inferred, not assumed: over all entries with
several records, a value is claimed by the sources whose records hold it and
denied by the other sources that have a record of the entry. Expectation-
maximisation on these claims gives each source a sensitivity (how often it holds
a true value) and a specificity (how often it does not hold a false one), and each
value a probability of being true. Values with the same pattern of claims and
denials have the same probability, so the whole corpus is counted into at most
3 ** sources patterns before the iterations start.

Single-valued fields take the value of the best qualified record in a given order
of trust; a multi-valued field keeps every value judged true.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many sources have a quality of their own; 3 ** 8 patterns are the most there can be.
MOST_SOURCES = 8
#: What stands for nobody.
NOBODY = ("na", "none", "null", "nil", "unknown", "nobody", "noone", "tbd", "todo", "anonymous", "unassigned")


def fit_quality(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[list[tuple[float, float]], dict[tuple[int, ...], float]]:
    """EM on counts of patterns; a pattern has 1 (holds), 0 (does not hold) or -1 (no record) for each source.

    Gives the (sensitivity, specificity) of each source and the probability of each
    pattern. Starts from the share of sources that hold the value; rates are
    smoothed by one true and one false value, so no pattern is impossible.
    """
    if not patterns:
        return [], {}
    width = len(next(iter(patterns)))
    belief = {p: (sum(x == 1 for x in p) + 0.5) / (sum(x >= 0 for x in p) + 1) for p in patterns}
    quality = [(0.5, 0.5)] * width
    for _ in range(rounds):
        total = sum(patterns.values())
        prior = min(0.99, max(0.01, sum(belief[p] * n for p, n in patterns.items()) / total))
        quality = []
        for s in range(width):
            own = [(p, n) for p, n in patterns.items() if p[s] >= 0]
            true = sum(belief[p] * n for p, n in own)
            false = sum((1 - belief[p]) * n for p, n in own)
            quality.append(((sum(belief[p] * n for p, n in own if p[s] == 1) + 1) / (true + 2), (sum((1 - belief[p]) * n for p, n in own if p[s] == 0) + 1) / (false + 2)))
        now = {}
        for p in patterns:
            odds = math.log(prior / (1 - prior))
            for x, (sensitivity, specificity) in zip(p, quality, strict=True):
                if x == 1:
                    odds += math.log(sensitivity / (1 - specificity))
                elif x == 0:
                    odds += math.log((1 - sensitivity) / specificity)
            now[p] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        moved = max(abs(now[p] - belief[p]) for p in patterns)
        belief = now
        if moved < 1e-9:
            break
    return quality, belief


def beliefs(records: DataFrame, keys: list[str], value: str, source: str, sources: tuple[str, ...]) -> DataFrame:
    """How likely each value of a field is true: (keys..., value, belief).

    Blank values claim nothing; records whose source is null or not among ``sources`` (fewer
    than ``MOST_SOURCES``) form a source of their own. Null keys form entries of their own.
    """
    if not 0 < len(sources) < MOST_SOURCES:
        raise ValueError(f"one to {MOST_SOURCES - 1} sources")
    place = F.lit(len(sources))
    for i, name in enumerate(sources):
        place = F.when(F.col(source) == name, F.lit(i)).otherwise(place)
    rows = records.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"), place.alias("_s"))
    own = [f"_k{i}" for i in range(len(keys))]
    present = rows.groupBy(*own).agg(F.collect_set("_s").alias("_here"))
    held = rows.where(~blank(F.col("_v"))).groupBy(*own, "_v").agg(F.collect_set("_s").alias("_held"))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"p.{k}")) for k in own]
    both = held.alias("h").join(present.alias("p"), same)
    marks = [F.when(F.array_contains("_held", i), F.lit("1")).when(F.array_contains("_here", i), F.lit("0")).otherwise(F.lit("-")) for i in range(len(sources) + 1)]
    claims = both.select(*[F.col(f"h.{k}").alias(k) for k in own], "_v", F.concat(*marks).alias("_pattern"))
    counted = {tuple("-01".index(c) - 1 for c in r["_pattern"]): r["n"] for r in claims.groupBy("_pattern").agg(F.count("*").alias("n")).collect()}
    _, belief = fit_quality(counted)
    fitted = [("".join("-01"[x + 1] for x in p), b) for p, b in belief.items()]
    table = F.broadcast(records.sparkSession.createDataFrame(fitted, "_pattern string, belief double"))  # at most 3 ** sources rows
    return claims.join(table, "_pattern").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_v").alias(value), "belief")


def true_values(judged: DataFrame, keys: list[str], value: str, least: float = 0.5) -> DataFrame:
    """Values of a multi-valued field that are judged true: (keys..., values array sorted)."""
    return judged.where(F.col("belief") >= least).groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"))


def blank(text: Column) -> Column:
    """Null, or only white space and invisible characters."""
    return F.coalesce(F.regexp_replace(text, r"(?U)[\s\p{Z}\p{Cf}\p{Cc}͏ᅟᅠㅤ︀-️ﾠ]+", "") == "", F.lit(True))


def somebody(name: Column) -> Column:
    """A name with letters that is no stand-in for nobody."""
    bare = F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))
    return F.coalesce((bare != "") & ~bare.isin(*NOBODY), F.lit(False))


def best_records(df: DataFrame, keys: list[str], fields: dict[str, tuple[Column, Column, list[Column]]], id_col: str = "id") -> DataFrame:
    """One row per entry with at least two ids: for each field the record (id, value) it comes from, or null.

    ``fields``: name to (may this record supply it, its value, order of trust, best
    highest). Ties go to the largest id. Groups are reduced before the shuffle, so
    an entry with very many records costs no more than one row per task.
    """
    wanted = []
    for name, (may, value, order) in fields.items():
        best = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(id_col).alias("id"), value.alias("value"))
        wanted.append(F.max(F.when(may, best)).alias(name))
    made = df.groupBy(*keys).agg(F.min(id_col).alias("_least"), F.max(id_col).alias("_most"), *wanted).where("_least < _most")
    return made.select(*keys, *[F.when(F.col(name).isNotNull(), F.struct(F.col(f"{name}.id").alias("id"), F.col(f"{name}.value").alias("value"))).alias(name) for name in fields])


def survive(df: DataFrame, keys: list[str], fields: dict[str, tuple[Column, Column, list[Column]]], judged: str, multi: str, source: str, sources: tuple[str, ...], id_col: str = "id") -> DataFrame:
    """The surviving record of each entry with at least two ids.

    Each field of ``fields`` as in ``best_records``; ``belief`` is how likely the chosen value
    of the field ``judged`` is true, ``values`` holds every value of the column ``multi`` that is
    judged true. Both come from the model; the order of trust, where it is fixed, comes
    before it. Rows that occur twice count once; an empty table gives an empty result.
    """
    best = best_records(df, keys, fields, id_col)
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    several = df.alias("d").join(best.select(*keys).alias("b"), same, "left_semi").select(*keys, judged, multi, source)
    chosen = beliefs(several, keys, judged, source, sources).select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], F.col(judged).alias("_value"), "belief")
    kept = true_values(beliefs(several, keys, multi, source, sources), keys, multi).select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], "values")
    to_chosen = [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)] + [F.col(f"{judged}.value") == F.col("_value")]
    to_kept = [F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)]
    return best.join(chosen, to_chosen, "left").join(kept, to_kept, "left").select(*keys, *fields, "belief", F.coalesce("values", F.array().cast("array<string>")).alias("values"))
