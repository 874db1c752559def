"""Declarative inputs: layout templates, truth files, and packs of files with digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Layout templates from JSON files, one per file (S9-S11); order of declaration is the order of file names.

    row_strategy defaults to grid, header_y_ratio to 0.25, required_fields to none. The manifest file is no
    template. Repeated template ids are refused.
    """
    column = "array<struct<name:string,left_ratio:double,right_ratio:double>>"
    raw = spark.read.option("multiLine", True).schema(
        f"template_id string, version string, header_tokens array<string>, columns {column}, required_fields array<string>, row_strategy string, header_y_ratio double"
    ).json(path)
    named = raw.withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where("_file <> 'manifest.json' and template_id is not null")
    repeated = named.groupBy("template_id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"template id occurs twice: {repeated[0][0]}")
    from pyspark.sql import Window

    return named.select(
        "template_id", F.coalesce("version", F.lit("1")).alias("version"), (F.row_number().over(Window.orderBy("_file")) - 1).alias("template_ord"), "header_tokens", "columns",
        F.coalesce("required_fields", F.array().cast("array<string>")).alias("required_fields"), F.coalesce("row_strategy", F.lit("grid")).alias("row_strategy"), F.coalesce("header_y_ratio", F.lit(0.25)).alias("header_y_ratio"),
    )


# The two published layouts that are known without any file.
KNOWN_TEMPLATES = [
    (
        "bohai_detail_v1", ["交易日期", "交易金额", "余额", "交易渠道", "摘要码描述", "对方账号", "对方名称", "交易时间"],
        [("transaction_date", 0.032, 0.143), ("transaction_amount", 0.143, 0.255), ("balance", 0.255, 0.385), ("channel", 0.385, 0.496),
         ("description", 0.496, 0.607), ("counterparty_account", 0.607, 0.701), ("counterparty_name", 0.701, 0.887), ("transaction_time", 0.887, 0.979)],
        ["transaction_date", "transaction_amount", "balance"], "grid",
    ),
    (
        "online_statement_v1", ["记账日期", "币种", "收入金额", "支出金额", "联机余额", "交易摘要", "交易对手信息", "客户摘要"],
        [("accounting_date", 0.034, 0.101), ("currency", 0.101, 0.195), ("income_amount", 0.195, 0.309), ("expense_amount", 0.309, 0.413),
         ("online_balance", 0.413, 0.520), ("transaction_summary", 0.520, 0.654), ("counterparty_info", 0.654, 0.832), ("customer_summary", 0.832, 0.980)],
        ["accounting_date", "currency", "online_balance"], "anchor_date",
    ),
]


def known_templates(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Layout templates of a directory, else the built-in ones."""
    if path is not None:
        return read_templates(spark, path)
    return spark.createDataFrame([(t, "1", k, tokens, columns, required, strategy, 0.25) for k, (t, tokens, columns, required, strategy) in enumerate(KNOWN_TEMPLATES)], schemas.TEMPLATES)


def template_faults(templates: DataFrame) -> DataFrame:
    """Templates that cannot be confirmed (E10, W10): template_id, fault no_columns, bad_range or overlap."""
    by_left = F.array_sort(F.transform("columns", lambda c: F.struct(c["left_ratio"].alias("l"), c["right_ratio"].alias("r"))))
    bad = F.exists("columns", lambda c: ~((c["left_ratio"] >= 0) & (c["left_ratio"] < c["right_ratio"]) & (c["right_ratio"] <= 1)))
    n = F.greatest(F.size("columns") - 1, F.lit(0))
    lap = F.exists(F.zip_with(F.slice(by_left, 1, n), F.slice(by_left, 2, n), lambda a, b: a["r"] > b["l"]), lambda x: x)
    fault = F.when(F.coalesce(F.size("columns"), F.lit(0)) < 1, "no_columns").when(bad, "bad_range").when(lap, "overlap")
    return templates.select("template_id", fault.alias("fault")).where("fault is not null")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Golden samples from JSON (S12): sample_id, transactions. A sample with a negative index or a row twice is refused."""
    df = spark.read.option("multiLine", True).schema(schemas.TRUTH).json(path).withColumn("sample_id", F.coalesce("sample_id", F.element_at(F.split(F.input_file_name(), "/"), -1)))
    keys = F.transform("transactions", lambda t: F.struct(t["page_index"], t["row_index"]))
    bad = F.exists("transactions", lambda t: (t["page_index"] < 0) | (t["row_index"] < 0) | t["page_index"].isNull() | t["row_index"].isNull())
    wrong = df.where(bad | (F.size(F.array_distinct(keys)) < F.size(keys))).select("sample_id").limit(1).collect()
    if wrong:
        raise ValueError(f"truth sample {wrong[0][0]} has unreadable or repeated row keys")
    return df


def file_digests(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """name, size and SHA-256 of files (S13, P24, F39), computed where the files are read."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return files.where(F.lower("name").rlike("(" + "|".join(s.lstrip(".") for s in suffixes) + ")$")) if suffixes else files


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of files that begin like a PDF (S15), whatever they are called."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.substring("content", 1, 5) == F.lit("%PDF-").cast("binary")).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_manifest(digests: DataFrame, path: str) -> None:
    """Write name, size and SHA-256 of a pack's files as one JSON part, sorted by name (K12); a pack is a few files."""
    digests.orderBy("name").coalesce(1).write.mode("overwrite").json(path)


def verify_pack(spark: SparkSession, files: str, manifest: str) -> DataFrame:
    """Files of a pack that are missing, unlisted or changed against its manifest (J20, J23); empty means intact."""
    from ledgerloom.operators.runs import manifest_diff

    expected = spark.read.schema("name string, size bigint, sha256 string").json(manifest)
    return manifest_diff(expected, file_digests(spark, files), "name", "sha256")
