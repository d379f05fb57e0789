"""Integrity rules for result files, as one report.

Rows of a checked file are (id, list, line): the first column, the second as text, and the raw line; ``at``, where there
is one, orders them as in the file. A report has rule, severity, n and up to five sorted examples; a rule without findings has n 0.
Rules give their findings as (rule, x) rows of any number, and the report counts them all in one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Severities of rules, and their findings: (rule, x).
Findings = tuple[dict[str, str], DataFrame]

EXAMPLES = 5


def id_lists(lines: DataFrame, header: tuple[str, str]) -> DataFrame:
    """Text lines (value) split into id, list and line; blank lines and the header are left out."""
    parts = F.split("value", "\t", 2)
    is_header = F.lower(F.trim("value")) == "\t".join(header).lower()
    rows = lines.where((F.trim("value") != "") & ~is_header)
    at = ["at"] if "at" in lines.columns else []
    return rows.select(F.trim(parts[0]).alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("list"), F.col("value").alias("line"), *at)


def _split(list_: Column) -> Column:
    """The list split at commas and trimmed; an empty list has no elements, a trailing comma leaves an empty one."""
    own = F.transform(F.split(list_, ","), lambda x: F.trim(x))
    return F.when(F.trim(list_) == "", F.array().cast("array<string>")).otherwise(own)


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select("id", _split(F.col("list")).alias("ids"))


def _targets(t: Column) -> Column:
    return t.startswith("S2-") | t.startswith("S3-")


def _in_rows(rows: DataFrame) -> DataFrame:
    """What a row shows by itself, all rules in one pass."""
    finding = lambda rule, x: F.struct(F.lit(rule).alias("rule"), x.alias("x"))
    once = lambda rule, x, test: F.when(test, F.array(finding(rule, x))).otherwise(F.array().cast("array<struct<rule:string,x:string>>"))
    found = F.concat(
        once("no_tab", F.col("line"), ~F.col("line").contains("\t")),
        once("duplicate_in_list", F.col("id"), F.size("ids") != F.size(F.array_distinct("ids"))),
        F.transform(F.filter("ids", lambda t: t.startswith("S1-")), lambda t: finding("reference_in_list", t)),
        F.transform(F.filter("ids", lambda t: ~_targets(t) & ~t.startswith("S1-")), lambda t: finding("bad_prefix", F.col("id"))))
    return rows.withColumn("ids", _split(F.col("list"))).select(F.explode(found).alias("f")).select("f.rule", "f.x")


def _named(rule: str, found: DataFrame, column: str) -> DataFrame:
    return found.select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("x"))


def list_findings(rows: DataFrame, required: DataFrame | None = None, known: DataFrame | None = None) -> list[Findings]:
    """Rules for one file of id lists: ``required`` (entity_id) has to be covered exactly, ``known`` (entity_id) holds all valid ids."""
    rules = ["no_tab", "duplicate_row", "duplicate_in_list", "reference_in_list", "bad_prefix"]
    found = [_in_rows(rows), _named("duplicate_row", rows.groupBy("id").count().where("count > 1"), "id")]
    if known is not None:
        one = _ids(rows).select(F.explode("ids").alias("t")).where(_targets(F.col("t")))
        rules.append("unknown_id")
        found.append(_named("unknown_id", one.join(known.select(F.col("entity_id").alias("t")), "t", "left_anti"), "t"))
    if required is not None:
        want = required.select(F.col("entity_id").alias("id"))
        rules += ["missing_record", "extra_record"]
        found += [_named("missing_record", want.join(rows.select("id"), "id", "left_anti"), "id"), _named("extra_record", rows.select("id").distinct().join(want, "id", "left_anti"), "id")]
    return [(dict.fromkeys(rules, "error"), reduce(DataFrame.unionByName, found))]


def not_candidates(matches: DataFrame, candidates: DataFrame) -> Findings:
    """Matched pairs that aren't among the candidates (a warning). Of rows that repeat an id the last one counts where rows have an order, else all do."""

    def pairs(rows: DataFrame) -> DataFrame:
        if "at" in rows.columns:
            rows = rows.groupBy("id").agg(F.max_by("list", "at").alias("list"))
        return _ids(rows).select("id", F.explode("ids").alias("t")).where("t <> ''").distinct()

    missing = pairs(matches).join(pairs(candidates), ["id", "t"], "left_anti").select(F.concat_ws(":", "id", "t").alias("pair"))
    return {"not_a_candidate": "warning"}, _named("not_a_candidate", missing, "pair")


def row_counts(rows: DataFrame) -> DataFrame:
    """Rows, and rows with an empty or a filled list."""
    filled = F.sum(F.when(F.trim("list") != "", 1).otherwise(0))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(filled, F.lit(0)).alias("filled"), (F.count(F.lit(1)) - F.coalesce(filled, F.lit(0))).alias("empty"))


def header_findings(first_line: str | None, header: tuple[str, str]) -> list[tuple[str, str]]:
    """(rule, severity) for a file's first line; None stands for an empty file."""
    if first_line is None or not first_line.strip():
        return [("empty_file", "error")]
    if "\t" not in first_line:
        return [("not_tab_separated", "error")]
    own = tuple(x.strip().lower() for x in first_line.strip("\r\n").split("\t"))
    return [] if own == tuple(h.lower() for h in header) else [("wrong_header", "error")]


def report(findings: list[Findings]) -> DataFrame:
    """rule, severity, n, examples: all findings counted once by rule and text, then by rule; only five texts a rule and task go on to be sorted."""
    severities = {rule: severity for rules, _ in findings for rule, severity in rules.items()}
    found = reduce(DataFrame.unionByName, [rows for _, rows in findings])
    rules = found.sparkSession.createDataFrame(list(severities.items()), "rule string, severity string")
    texts = found.groupBy("rule", "x").agg(F.count(F.lit(1)).alias("n"))
    totals = texts.groupBy("rule").agg(F.sum("n").alias("n"))
    first = texts.withColumn("at", F.row_number().over(W.partitionBy("rule").orderBy("x"))).where(F.col("at") <= EXAMPLES)
    examples = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("examples"))
    out = rules.join(F.broadcast(totals), "rule", "left").join(F.broadcast(examples), "rule", "left")  # a row for each rule
    return out.select("rule", "severity", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))
