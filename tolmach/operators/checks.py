"""Quality checks of source and target pairs: one array of findings per segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, text

ISSUES = "array<struct<kind:string,severity:string,message:string>>"


def _issue(kind: str, severity: str | Column, message: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), message.alias("message"))


def none() -> Column:
    """No findings."""
    return F.array().cast(ISSUES)


def _list(items: Column) -> Column:
    return F.array_join(F.transform(items, text.quoted), ", ")


def placeholder_issues(source: Column, target: Column) -> Column:
    """At most one error: placeholders of ``source`` and ``target`` (arrays) that are missing or unexpected."""
    missing, extra = text.multiset_minus(source, target), text.multiset_minus(target, source)
    return _mismatch(missing, extra)


def _mismatch(missing: Column, extra: Column) -> Column:
    parts = F.concat_ws("; ", F.when(F.size(missing) > 0, F.concat(F.lit("missing "), _list(missing))), F.when(F.size(extra) > 0, F.concat(F.lit("unexpected "), _list(extra))))
    made = F.array(_issue("placeholder", "error", text.printable(F.concat(F.lit("placeholder mismatch: "), parts))))
    return F.when((F.size(missing) == 0) & (F.size(extra) == 0), none()).otherwise(made)


def length_issues(source_plain: Column, target_plain: Column, max_width: Column, tolerance: Column) -> Column:
    """An error over a declared width; otherwise a warning over the expansion budget. Tolerance 0 turns the warning off, null is 1."""
    n, m = F.length(target_plain), F.length(source_plain)
    scale = F.coalesce(tolerance.cast("double"), F.lit(1.0))
    budget = text.length_budget(m, scale)
    hard = F.concat(F.lit("over the "), max_width.cast("string"), F.lit(" character budget declared for this string ("), n.cast("string"), F.lit(" characters)"))
    soft = F.concat(n.cast("string"), F.lit(" characters against a "), budget.cast("string"), F.lit(" character budget for a "), m.cast("string"), F.lit(" character source"))
    return (
        F.when(max_width > 0, F.when(n > max_width, F.array(_issue("length", "error", hard))).otherwise(none()))
        .when((scale > 0) & (n > budget), F.array(_issue("length", "warning", soft)))
        .otherwise(none())
    )


def terminology_issues(source: Column, target: Column, glossary: Column) -> Column:
    """One warning per term (source, target, cased) that the source has and the target lacks, in the glossary's order.

    ``source`` and ``target`` are structs of the visible text (plain) and the same in lower case (lower).
    """
    unmet = F.filter(
        F.coalesce(glossary, F.array().cast("array<struct<source:string,target:string,cased:boolean>>")),
        lambda t: (t["source"] != "") & (t["target"] != "") & text.contains_word(source["plain"], t["source"], t["cased"], source["lower"]) & ~text.contains_word(target["plain"], t["target"], t["cased"], target["lower"]),
    )
    return F.transform(unmet, lambda t: _issue("terminology", "warning", text.printable(F.concat(F.lit("glossary: "), text.quoted(t["source"]), F.lit(" should be translated as "), text.quoted(t["target"])))))


def both_cases(plain: Column) -> Column:
    """A text and the same in lower case, as one struct."""
    return F.struct(plain.alias("plain"), F.lower(plain).alias("lower"))


def consistency_issues(target: Column, variants: Column) -> Column:
    """A warning that names up to three approved wordings (array) other than the target."""
    own = text.trim_space(target)
    other = F.array_sort(F.filter(F.transform(F.coalesce(variants, F.array().cast("array<string>")), text.trim_space), lambda v: (v != "") & (v != own)))
    more = F.when(F.size(other) > 3, F.concat(F.lit(" and "), (F.size(other) - 3).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    message = F.concat(F.lit("the same source string is approved elsewhere as "), _list(F.slice(other, 1, 3)), more)
    return F.when(text.is_blank(target) | (F.size(other) == 0), none()).otherwise(F.array(_issue("inconsistency", "warning", text.printable(message))))


def glossary_by_project(terms: DataFrame) -> DataFrame:
    """Each project's terms as one array in the order of their source: (project_id, glossary)."""
    entry = F.struct(F.col("source_term").alias("source"), F.col("target_term").alias("target"), F.coalesce("case_sensitive", F.lit(False)).alias("cased"))
    return terms.where(F.col("source_term").isNotNull() & F.col("target_term").isNotNull()).groupBy("project_id").agg(F.array_sort(F.collect_list(entry)).alias("glossary"))


def run_checks(segments: DataFrame) -> DataFrame:
    """Adds ``issues`` to rows with source_text, target_text, max_width, tolerance, dialect, glossary and variants.

    Instead of ``variants`` (an array of approved wordings) rows may hold ``others``, the
    message of ``inconsistent`` or null. Nothing is checked while the target is blank.
    Each text is parsed once.
    """
    read = segments.withColumns({"_rs": markup.read_fragment(F.col("source_text"), F.col("dialect")), "_rt": markup.read_fragment(F.col("target_text"), F.col("dialect"))})
    # columns of their own, so nothing is worked out again for each term
    read = read.withColumns({"_missing": text.multiset_minus(F.col("_rs.names"), F.col("_rt.names")), "_extra": text.multiset_minus(F.col("_rt.names"), F.col("_rs.names")), "_s": both_cases(F.col("_rs.plain")), "_t": both_cases(F.col("_rt.plain"))})
    if "others" in segments.columns:
        consistency = F.when(F.col("others").isNull(), none()).otherwise(F.array(_issue("inconsistency", "warning", F.col("others"))))
    else:
        consistency = consistency_issues(F.col("target_text"), F.col("variants"))
    found = F.concat(
        _mismatch(F.col("_missing"), F.col("_extra")),
        length_issues(F.col("_s.plain"), F.col("_t.plain"), F.coalesce("max_width", F.lit(0)), F.col("tolerance")),
        terminology_issues(F.col("_s"), F.col("_t"), F.col("glossary")),
        consistency,
    )
    return read.withColumn("issues", F.when(text.is_blank(F.col("target_text")), none()).otherwise(found)).drop("_s", "_t", "_rs", "_rt", "_missing", "_extra")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with digests of their source and of their trimmed target as keys."""
    return rows.withColumns({"skey": F.md5("source_text"), "tkey": F.md5(text.trim_space(F.col("target_text")))})


def inconsistent(rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Messages on wordings other than the approved ones: (project_id, skey, tkey, others).

    ``rows``: (project_id, source_text, target_text, status); ``among``: rows whose approved
    wordings count as well. Keys are digests of the source and of the trimmed target. A
    source's approved wordings are ranked and the first four kept beside their number:
    three others can be named whichever is the row's own, so no array grows with the
    wordings of a source.
    """
    counted = (F.col("status") == "approved") & (F.col("target_text") != "")
    parts = rows.select("project_id", "source_text", "target_text", counted.alias("counts"))
    if among is not None:
        parts = parts.union(among.where(counted).select("project_id", "source_text", "target_text", F.lit(True)))
    trimmed = parts.withColumn("t", text.trim_space(F.col("target_text"))).where("t <> ''")
    raw = F.when(F.col("counts"), F.md5("target_text")).alias("raw")
    each = trimmed.select("project_id", F.md5("source_text").alias("skey"), F.md5("t").alias("tkey"), "t", raw).distinct()
    own = each.groupBy("project_id", "skey", "tkey").agg(F.first("t").alias("t"), F.count("raw").alias("own"))
    # most sources have one wording only, and those go no further
    source = Window.partitionBy("project_id", "skey")
    several = own.withColumns({"all": F.sum("own").over(source), "n": F.count("*").over(source)}).where("all > 0 AND n > 1")
    placed = several.withColumn("r", F.row_number().over(source.orderBy((F.col("own") > 0).desc(), "t")))
    best = placed.groupBy("project_id", "skey").agg(*[F.max(F.when((F.col("r") == i) & (F.col("own") > 0), F.struct("t", "own"))).alias(f"w{i}") for i in range(1, 5)])
    judged = placed.join(best, ["project_id", "skey"]).withColumn("left", F.col("all") - F.col("own")).where("left > 0")
    listed = F.filter(F.array("w1", "w2", "w3", "w4"), lambda x: x["t"] != F.col("t"))  # a null is no wording
    other = F.slice(F.flatten(F.transform(listed, lambda x: F.array_repeat(x["t"], F.least(x["own"], F.lit(3)).cast("int")))), 1, 3)
    more = F.when(F.col("left") > 3, F.concat(F.lit(" and "), (F.col("left") - 3).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return judged.select("project_id", "skey", "tkey", text.printable(F.concat(F.lit("the same source string is approved elsewhere as "), _list(other), more)).alias("others"))


def with_others(rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Adds ``others`` to rows (project_id, source_text, target_text, status): what ``inconsistent`` says of them, or null."""
    return _keyed(rows).join(inconsistent(rows, among), ["project_id", "skey", "tkey"], "left").drop("skey", "tkey")


def blocking(issues: Column) -> Column:
    """Whether a finding is an error."""
    return F.exists(issues, lambda i: i["severity"] == "error")


def first_blocking(issues: Column) -> Column:
    """The message of the first error, or null."""
    return F.try_element_at(F.filter(issues, lambda i: i["severity"] == "error"), F.lit(1))["message"]


def place(segments: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """Segments with the project, dialect and tolerance of their file."""
    where = files.select(F.col("id").alias("file_id"), "project_id", text.dialect(F.col("format")).alias("dialect")).join(projects.select(F.col("id").alias("project_id"), F.col("length_tolerance").alias("tolerance")), "project_id")
    return segments.join(where, "file_id")


def recheck(segments: DataFrame, files: DataFrame, projects: DataFrame, terms: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """All findings of all segments: (segment_id, kind, severity, message, ordinal).

    Consistency is judged against approved segments of the same project with the same
    source. With ``only`` (file_id) just the segments of these files are checked, still
    against all approved ones.
    """
    placed = place(segments, files, projects)
    rows = with_others(placed) if only is None else with_others(placed.join(only.select("file_id").distinct(), "file_id", "left_semi"), placed)
    checked = run_checks(rows.join(glossary_by_project(terms), "project_id", "left"))
    return checked.select(F.col("id").alias("segment_id"), F.posexplode("issues").alias("ordinal", "issue")).select("segment_id", "issue.kind", "issue.severity", "issue.message", "ordinal")
