"""Delimited uploads: encoding and delimiter detection, tolerant parsing, header mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.functions.columns import clean_null


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Raw lines of an upload, decoded, NUL bytes removed, blank and comment lines dropped."""
    lines = spark.read.option("encoding", encoding).option("header", False).option("sep", "\u0001").option("quote", "").csv(path)
    text = F.trim(F.regexp_replace(F.col("_c0"), "\u0000", ""))
    return lines.select(text.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """First encoding of the list whose decoding shows no replacement characters."""
    for encoding in rules.TEXT_ENCODINGS:
        broken = read_lines(spark, path, encoding).agg(F.count_if(F.col("line").contains("�")).alias("n")).first()["n"]
        if not broken:
            return encoding
    return rules.TEXT_ENCODINGS[-1]


def detect_delimiter(lines: DataFrame) -> str:
    """Delimiter with the highest mean number of occurrences per line."""
    counts = {d: F.length("line") - F.length(F.replace("line", F.lit(d), F.lit(""))) for d in rules.DELIMITERS}
    row = lines.agg(*[F.avg(c).alias(str(i)) for i, c in enumerate(counts.values())]).first()
    best = max(range(len(rules.DELIMITERS)), key=lambda i: (row[i] or 0.0, -i))
    return rules.DELIMITERS[best]


def read_with_rejects(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(all-string table with NULL for missing values, rows that do not fit the header with their raw text).

    The files are read in parallel by Spark's own CSV source; only the header is looked at here. Rows that do not fit are cleaned
    (:func:`cleaned`) and parsed once more; what fits then is part of the table, what does not keeps its text in _corrupt_record.
    NUL bytes are removed from names and values.
    """
    encoding = encoding or detect_encoding(spark, path)
    delimiter = delimiter or detect_delimiter(read_lines(spark, path, encoding))
    columns = _csv(spark, encoding, delimiter).csv(path).columns
    rows = _with_misfits(spark, path, columns, delimiter, encoding)
    raw = F.col("_corrupt_record")
    tried = rows.withColumn("_again", F.when(raw.isNotNull(), F.from_csv(cleaned(raw), _fields([*columns, "_unfit"]), _misfits(delimiter, "_unfit"))))
    unfit = raw.isNotNull() & F.col("_again._unfit").isNotNull()
    first = {c: F.replace(F.col(f"`{c}`"), F.lit("\u0000"), F.lit("")) for c in columns}
    values = [F.when(raw.isNull(), first[c]).otherwise(F.col(f"_again.`{c}`")) for c in columns]
    names = [c.replace("\u0000", "").strip() for c in columns]
    return tried.filter(~unfit).select(*[clean_null(v).alias(n) for v, n in zip(values, names)]), tried.filter(unfit).drop("_again")


def cleaned(line: Column) -> Column:
    """A raw line trimmed, without NUL bytes, and with doubled quotes made single, so that ``""A, B""`` is one quoted value."""
    return F.replace(F.trim(F.replace(line, F.lit("\u0000"), F.lit(""))), F.lit('""'), F.lit('"'))


def read_table(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """The rows that fit the header; :func:`read_with_rejects` gives the others too."""
    return read_with_rejects(spark, path, encoding, delimiter)[0]


def _csv(spark: SparkSession, encoding: str, delimiter: str) -> DataFrameReader:
    return spark.read.option("header", True).option("encoding", encoding).option("sep", delimiter).option("quote", '"').option("escape", '"').option("comment", "#")


def _fields(columns: list[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def _misfits(delimiter: str, column: str) -> dict[str, str]:
    return {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": column}


def _with_misfits(spark: SparkSession, path: str, columns: list[str], delimiter: str, encoding: str) -> DataFrame:
    reader = _csv(spark, encoding, delimiter).options(**_misfits(delimiter, "_corrupt_record")).schema(_fields([*columns, "_corrupt_record"]))
    return reader.option("columnPruning", False).csv(path)


def split_malformed(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", encoding: str = "utf-8") -> tuple[DataFrame, DataFrame]:
    """(good rows, rows that do not fit the columns with their raw text in _corrupt_record)."""
    rows = _with_misfits(spark, path, columns, delimiter, encoding)
    bad = F.col("_corrupt_record").isNotNull()
    return rows.filter(~bad).drop("_corrupt_record"), rows.filter(bad)


def header_plan(columns: list[str], wanted: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Actual column name to wanted name: same name in any case, else a header containing an alias.

    Columns already carrying a wanted name are left alone, and a column is used at most once.
    """
    plan: dict[str, str] = {}
    free = [c for c in columns if c not in wanted]
    for target in wanted:
        if target in columns:
            continue
        exact = [c for c in free if c.lower().strip() == target.lower().strip()]
        loose = [c for c in free if any(a in c.lower().strip() for a in aliases.get(target, []))]
        hit = next((c for c in exact + loose if c not in plan), None)
        if hit:
            plan[hit] = target
    return plan


def map_headers(df: DataFrame, required: list[str], optional: list[str], aliases: dict[str, list[str]]) -> DataFrame:
    """Rename an upload to the registry headers; raise when a required one cannot be found."""
    plan = header_plan(df.columns, [*required, *optional], aliases)
    renamed = df.withColumnsRenamed(plan)
    missing = [c for c in required if c not in renamed.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}. Available columns: {df.columns}")
    return renamed


def label_upload(df: DataFrame) -> DataFrame:
    """Label upload with registry column names, ready for permit matching and upserts."""
    mapped = map_headers(df, rules.REQUIRED_LABEL_COLUMNS, rules.IMPORTANT_LABEL_COLUMNS, rules.LABEL_COLUMN_ALIASES)

    def pick(name: str) -> Column:
        return F.col(f"`{name}`") if name in mapped.columns else F.lit(None).cast("string")

    return mapped.select(
        F.upper(F.trim(pick("Permit No."))).alias("permit_no"), F.trim(pick("Brand Name")).alias("brand_name"), F.trim(pick("TTB ID")).alias("ttb_id"),
        pick("Class Type").alias("class_type"), pick("Class Type Desc").alias("class_type_desc"), pick("Origin Desc").alias("origin_desc"),
        pick("Serial Number").alias("serial_number"), pick("Completed Date").alias("completed_date"), pick("Fanciful Name").alias("fanciful_name"),
        pick("Origin").alias("origin"),
    )


def contact_upload(df: DataFrame) -> DataFrame:
    optional = [c for c in rules.CONTACT_COLUMN_ALIASES if c not in rules.REQUIRED_CONTACT_COLUMNS]
    return map_headers(df, rules.REQUIRED_CONTACT_COLUMNS, optional, rules.CONTACT_COLUMN_ALIASES)
