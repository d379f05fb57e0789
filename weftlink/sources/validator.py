"""Checking result files: every rule, warnings for what can't be checked, and an exit code.

``python -m weftlink.sources.validator -m matches.tsv -c candidates.tsv -t test_folder [--check-ids]`` prints the report and ends with
1 if there is an error, else with 0.
"""

from __future__ import annotations

import argparse
import sys

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.operators import validation
from weftlink.sources import tsv


def _as_finding(spark: SparkSession, rule: str, severity: str, x: str) -> validation.Findings:
    return {rule: severity}, spark.createDataFrame([(rule, x)], "rule string, x string")


def _unreadable(spark: SparkSession, path: str) -> str | None:
    """Why a file can't be opened, or None; folders of part files are left to the reader."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.getFileStatus(p).isDirectory():
            fs.open(p).close()
    except Py4JJavaError as e:
        return str(e.java_exception)
    return None


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and ``at``, which orders lines as they stand in their file."""
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return spark.read.text(path).select("value", order.alias("at"))


def check_file(spark: SparkSession, path: str, header: tuple[str, str], required: DataFrame, known: DataFrame | None) -> tuple[DataFrame | None, list[validation.Findings]]:
    """(rows, findings) of one file. No rows where it is missing, empty, unreadable or has a wrong header, as nothing else can be said of it."""
    if not tsv.exists(spark, path):
        return None, [_as_finding(spark, "missing_file", "error", path)]
    if why := _unreadable(spark, path):
        return None, [_as_finding(spark, "unreadable_file", "error", why)]
    lines = read_lines(spark, path)
    garbled = lines.where(~F.is_valid_utf8("value")).select(F.lit("not_utf8").alias("rule"), F.lit(path).alias("x"))
    if garbled.head(1):
        return None, [({"not_utf8": "error"}, garbled)]
    first = lines.head(1)
    if broken := validation.header_findings(first[0]["value"] if first else None, header):
        return None, [_as_finding(spark, rule, severity, path) for rule, severity in broken]
    rows = validation.id_lists(lines, header)
    return rows, validation.list_findings(rows, required, known)


def check_results(spark: SparkSession, matches: str, candidates: str | None, test_dir: str, check_ids: bool = False) -> DataFrame:
    """file, rule, severity, n, examples for the match file, the candidate file (may be absent) and both together."""
    out: list[tuple[str, list[validation.Findings]]] = []
    source = f"{test_dir}/test_source1.tsv"
    if not tsv.exists(spark, source):
        out.append(("test", [_as_finding(spark, "missing_test_source", "error", source)]))
    else:
        required, known, about = tsv.read_ids(spark, source), None, []
        if check_ids:
            paths = [f"{test_dir}/test_source{i}.tsv" for i in (2, 3)]
            absent = [p for p in paths if not tsv.exists(spark, p)]
            about = [_as_finding(spark, "ids_not_checked", "warning", p) for p in absent[:1]]
            known = None if absent else tsv.read_ids(spark, paths[0]).unionByName(tsv.read_ids(spark, paths[1]))
        else:
            about = [_as_finding(spark, "ids_not_checked", "warning", "not asked for")]
        matched, found = check_file(spark, matches, tsv.LISTS, required, known)
        out.append(("matches", found))
        proposed = None
        if candidates and tsv.exists(spark, candidates):
            proposed, found = check_file(spark, candidates, tsv.CANDIDATES, required, known)
            out.append(("candidates", found))
        elif candidates:
            about.append(_as_finding(spark, "no_candidate_file", "warning", candidates))
        if matched is not None and proposed is not None:
            about.append(validation.not_candidates(matched, proposed))
        if about:
            out.append(("both", about))
    parts = [validation.report(found).select(F.lit(file).alias("file"), "rule", "severity", "n", "examples") for file, found in out]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description="Checks result files of a linkage run.")
    parser.add_argument("-m", "--matching", default="output/matching_results.tsv")
    parser.add_argument("-c", "--candidate", default="output/candidate_pairs.tsv")
    parser.add_argument("-t", "--test-dir", default="dataset/test")
    parser.add_argument("--check-ids", action="store_true", help="also look every listed id up in the target tables")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("validator").getOrCreate()
    found = [r for r in check_results(spark, args.matching, args.candidate, args.test_dir, args.check_ids).collect() if r.n]
    for r in sorted(found, key=lambda r: (r.severity, r.file, r.rule)):
        print(f"{r.severity.upper()}: {r.file}: {r.rule}: {r.n}, e.g. {r.examples}")
    failed = any(r.severity == "error" for r in found)
    print("FAIL" if failed else "PASS")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
