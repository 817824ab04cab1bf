"""Queries on rejected lines whose files left their contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.contracts import CONTRACTS
from sedimenta.operators.drift import JUDGED, read_consistent, read_records, schema_changes
from sedimenta.session import cut, scan


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(scan(spark, sf_dir, "quarantine_records")).select("source_file", "change_kind", "column_path", "seen_path")


def p3_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable question lines as one table."""
    lines = scan(spark, sf_dir, "quarantine_records")
    return read_consistent(lines, cut(schema_changes(lines, inside=True)), "questions")


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable lines of all entities as one table."""
    lines = scan(spark, sf_dir, "quarantine_records")
    return read_records(lines, cut(schema_changes(lines, inside=True)))


def p3_type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that hold values of another type under their contract name."""
    return p3_found(spark, sf_dir).where("change_kind = 'type_changed'").select("source_file", "column_path")


def p3_rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable lines by entity and file, and those from which something had to be rescued."""
    counts = [F.count(F.lit(1)).alias("readable"), F.count("_rescued_data").alias("with_rescued")]
    return p3_records(spark, sf_dir).groupBy("entity", "source_file").agg(*counts)


def p3_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the consistent table by entity and file."""
    return p3_rescued(spark, sf_dir).where("source_file IS NOT NULL").select("entity", "source_file", "readable")


QUERIES = {"p3_readable": p3_readable, "p3_type_changes": p3_type_changes, "p3_rescued": p3_rescued, "p3_found": p3_found, "p3_questions": p3_questions, "p3_records": p3_records}


# what DuckDB calls a JSON value that a contract type takes
_TAKEN = {"bigint": "'BIGINT', 'UBIGINT'", "int": "'BIGINT', 'UBIGINT'", "boolean": "'BOOLEAN'", "array<string>": "'ARRAY'", "struct": "'OBJECT'"}


def _judged_fields() -> list[tuple[str, str, str, str]]:
    out = []
    for e, c in CONTRACTS.items():
        for k, kind in c.tree.items():
            out.append((e, k, f'$."{k}"', "struct" if isinstance(kind, dict) else kind))
            if k == JUDGED and isinstance(kind, dict):
                out += [(e, f"{k}.{x}", f'$."{k}"."{x}"', v) for x, v in kind.items()]
    return [f for f in out if f[3] != "string"]


def _wrong(path: str, kind: str) -> str:
    bad = f"json_type(j, '{path}') NOT IN ('NULL', {_TAKEN[kind]})"
    return f"({bad} OR TRY_CAST(json_extract_string(j, '{path}') AS HUGEINT) NOT BETWEEN -2147483648 AND 2147483647)" if kind == "int" else bad


# DuckDB takes a comma before the end, which strict JSON does not
_READABLE = "SELECT entity, _source_file, raw_record::JSON AS j FROM quarantine_records WHERE _source_file IS NOT NULL AND json_valid(raw_record) AND NOT regexp_matches(raw_record, ',\\s*\\}\\s*$') AND json_type(raw_record) = 'OBJECT'"
ORACLES: dict[str, str] = {
    "p3_readable": f"SELECT entity, _source_file AS source_file, count(*) AS readable FROM ({_READABLE}) WHERE entity IN ({', '.join(repr(e) for e in CONTRACTS)}) GROUP BY ALL",
    "p3_type_changes": f"WITH lines AS ({_READABLE}) "
    + " UNION ".join(f"SELECT _source_file AS source_file, '{name}' AS column_path FROM lines WHERE entity = '{e}' AND {_wrong(path, kind)}" for e, name, path, kind in _judged_fields()),
}
