"""Batch scans of files and streams of messages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from vitalgrid.sources.line_log import LineLog
from vitalgrid.sources.registry import LABELLED_COLUMNS


def labelled_schema() -> str:
    return re.sub(r"\s+", " ", LABELLED_COLUMNS).strip()


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 40-column labelled table: no header, comma, optional quotes."""
    return spark.read.schema(labelled_schema()).option("quote", '"').csv(path)


def parse_labelled_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The same rows from a column of text, for lines that arrive in a stream."""
    row = F.from_csv(F.col(value), labelled_schema(), {"quote": '"'})
    return lines.select(row.alias("r")).select("r.*")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-sensor prediction files: a header, an index column that is dropped, then
    label, prediction and window."""
    schema = "colNum BIGINT, label STRING, prediction STRING, window BIGINT"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path).drop("colNum")


def read_messages(
    spark: SparkSession, path: str, max_files: int | None = None, topic: str | None = None
) -> DataFrame:
    """Text messages from a folder as a stream of ``(topic, value)``."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    name = F.lit(topic) if topic else F.element_at(F.split(F.input_file_name(), "/"), -2)
    return reader.load(path).select(name.alias("topic"), "value")


def read_broker(
    spark: SparkSession, servers: str, topics: list[str], group: str | None = None,
    max_offsets: int | None = None,
) -> DataFrame:
    """The same contract from a message broker; needs Spark's Kafka package."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
    )
    if group:
        reader = reader.option("kafka.group.id", group)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().selectExpr("topic", "CAST(value AS STRING) AS value")


def read_log(
    spark: SparkSession, path: str, topics: list[str], group: str | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """The same contract from folders of append-only line logs, with offsets and a consumer
    group's position; ``max_bytes`` bounds a batch, and one ``availableNow`` run is one batch."""
    spark.dataSource.register(LineLog)
    reader = spark.readStream.format("line_log").option("path", path).option("topics", ",".join(topics))
    if group:
        reader = reader.option("group", group)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load()


def union_streams(streams: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


# --- model catalog --------------------------------------------------------------

# Layouts of model file names.
FOREST_NAME = r"(?i)^([^_]+)_(.+)_FEA_\.MDL$"
PLAIN_NAME = r"(?i)^sk_([^_]+)_(.+)_FEA_\.MDL$"


def parse_model_names(files: DataFrame, path: str = "path") -> DataFrame:
    """``(sensor, userid, kind, path)`` from model files named after sensor and user;
    other files are left out and each (sensor, user) is kept once."""
    name = F.substring_index(F.col(path), "/", -1)
    plain = name.rlike(PLAIN_NAME)
    forest = ~plain & name.rlike(FOREST_NAME) & ~F.lower(name).startswith("sk_")
    pattern = lambda g: F.when(plain, F.regexp_extract(name, PLAIN_NAME, g)).otherwise(
        F.regexp_extract(name, FOREST_NAME, g)
    )
    return (
        files.where(plain | forest)
        .select(
            pattern(1).alias("sensor"), pattern(2).alias("userid"),
            F.when(plain, "plain").otherwise("forest").alias("kind"), path,
        )
        .groupBy("sensor", "userid", "kind")
        .agg(F.min(path).alias(path))
    )


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """Models under ``folder``; only names are read, never contents.

    A model is one file, or a folder with a ``metadata`` folder in it, as pipelines are saved.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .load(folder).select("path", "length")
    ).where("length > 0")
    inside = F.regexp_extract("path", r"(?i)^(.*\.MDL)/metadata/[^/]+$", 1)
    return parse_model_names(files.withColumn("path", F.when(inside != "", inside).otherwise(F.col("path"))))


def users_with_models(catalog: DataFrame) -> DataFrame:
    return catalog.select("userid").distinct()


# --- Bayesian network files -----------------------------------------------------

VARIABLE_BLOCK = r"variable\s+(\w+)\s*\{\s*type\s+discrete\s*\[\s*\d+\s*\]\s*\{([^}]*)\}"
TABLE_BLOCK = r"probability\s*\(\s*(\w+)\s*\|?([^)]*)\)\s*\{([^}]*)\}"
INTERVAL = r"^[\[_]([^_\]]+)_([^_\]]+)\]$"


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """One row per network file: ``(network, text)``. A file is a few kilobytes."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.bif$", "").alias("network"),
        F.col("value").alias("text"),
    )


def _trimmed_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda s: F.trim(s))


def network_states(networks: DataFrame) -> DataFrame:
    """``(network, variable, idx, state, lo, hi)``; bounds only for intervals."""
    blocks = networks.select(
        "network", F.explode(F.regexp_extract_all("text", F.lit(VARIABLE_BLOCK), F.lit(0))).alias("b")
    )
    return (
        blocks.select(
            "network", F.regexp_extract("b", VARIABLE_BLOCK, 1).alias("variable"),
            F.posexplode(_trimmed_list(F.regexp_extract("b", VARIABLE_BLOCK, 2))).alias("idx", "state"),
        )
        .withColumn("lo", F.regexp_extract("state", INTERVAL, 1).try_cast("double"))
        .withColumn("hi", F.regexp_extract("state", INTERVAL, 2).try_cast("double"))
    )


def network_cuts(states: DataFrame) -> DataFrame:
    """Cut points per signal, ``(network, variable, cuts)``."""
    return (
        states.where("lo IS NOT NULL").groupBy("network", "variable")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "lo", "hi"))).alias("s"))
        .select(
            "network", "variable",
            F.concat(F.array(F.col("s")[0]["lo"]), F.transform("s", lambda x: x["hi"])).alias("cuts"),
        )
    )


def network_tables(networks: DataFrame) -> DataFrame:
    """``(network, variable, given, state, p)`` with states as numbers, ``given`` in
    the listed order of the parents."""
    states = network_states(networks)
    rows = (
        networks.select(
            "network", F.explode(F.regexp_extract_all("text", F.lit(TABLE_BLOCK), F.lit(0))).alias("b")
        )
        .select(
            "network", F.regexp_extract("b", TABLE_BLOCK, 1).alias("variable"),
            _trimmed_list(F.regexp_extract("b", TABLE_BLOCK, 2)).alias("parents"),
            F.explode(F.split(F.regexp_extract("b", TABLE_BLOCK, 3), ";")).alias("line"),
        )
        .where(F.col("line").rlike(r"\S"))
        .select(
            "network", "variable", "parents",
            _trimmed_list(F.regexp_extract("line", r"\(([^)]*)\)", 1)).alias("names"),
            _trimmed_list(F.regexp_replace("line", r"^\s*(\([^)]*\)|table)", "")).alias("ps"),
        )
    )
    # State names to numbers through one small map per network.
    numbers = states.groupBy("network").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws("=", "variable", "state").alias("k"), F.col("idx")))
        ).alias("number")
    )
    named = rows.join(numbers, "network")
    given = F.transform(
        F.arrays_zip("parents", "names"),
        lambda z: F.col("number")[F.concat_ws("=", z["parents"], z["names"])].cast("string"),
    )
    return named.select(
        "network", "variable", F.concat_ws(",", given).alias("given"),
        F.posexplode("ps").alias("state", "_p"),
    ).select("network", "variable", "given", "state", F.col("_p").try_cast("double").alias("p"))


def network_text(tables: DataFrame, cuts: DataFrame, labels: list[str], parents: dict[str, list[str]]) -> DataFrame:
    """Write fitted tables as network text, one row per network: ``(network, text)``.

    A network has a fixed number of table rows, so the lists gathered per network
    are bounded by its structure.
    """
    name = F.when(F.col("i") == 0, F.concat(F.lit("["), F.col("lo"), F.lit("_"), F.col("hi"), F.lit("]"))).otherwise(
        F.concat(F.lit("_"), F.col("lo"), F.lit("_"), F.col("hi"), F.lit("]"))
    )
    spans = cuts.select(
        "network", "variable",
        F.posexplode(F.arrays_zip(F.slice("cuts", 1, 4).alias("a"), F.slice("cuts", 2, 4).alias("b"))).alias("i", "z"),
    ).select(
        "network", "variable", "i",
        F.col("z.a").cast("string").alias("lo"), F.col("z.b").cast("string").alias("hi"),
    )
    signal_names = spans.groupBy("network", "variable").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", name.alias("n")))), lambda x: x["n"]).alias("names")
    )
    label_names = cuts.select("network").distinct().select(
        "network", F.lit("Activity").alias("variable"), F.array(*[F.lit(s) for s in labels]).alias("names")
    )
    names = signal_names.unionByName(label_names)
    by_variable = names.groupBy("network").agg(
        F.map_from_entries(F.collect_list(F.struct("variable", "names"))).alias("names")
    )
    order = F.create_map(*[x for i, v in enumerate(parents) for x in (F.lit(v), F.lit(i))])
    listed = F.create_map(
        *[x for v, p in parents.items() for x in (F.lit(v), F.array(*[F.lit(q) for q in p]).cast("array<string>"))]
    )
    lines = (
        tables.groupBy("network", "variable", "given")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("state", "p"))), lambda x: x["p"].cast("string")).alias("ps"))
        .join(by_variable, "network")
        .withColumn("parents", listed[F.col("variable")])
        .withColumn(
            "head",
            F.when(F.col("given") == "", F.lit("  table ")).otherwise(
                F.concat(
                    F.lit("  ("),
                    F.concat_ws(
                        ", ",
                        F.transform(
                            F.arrays_zip("parents", F.split("given", ",").alias("g")),
                            lambda z: F.col("names")[z["parents"]][z["g"].cast("int")],
                        ),
                    ),
                    F.lit(") "),
                )
            ),
        )
        .groupBy("network", "variable")
        .agg(
            F.concat_ws(
                "\n",
                F.transform(
                    F.sort_array(F.collect_list(F.struct("given", F.concat("head", F.concat_ws(", ", "ps"), F.lit(";")).alias("t")))),
                    lambda x: x["t"],
                ),
            ).alias("body")
        )
        .select(
            "network", "variable",
            F.concat(
                F.lit("probability ( "), F.col("variable"),
                F.when(F.size(listed[F.col("variable")]) > 0,
                       F.concat(F.lit(" | "), F.concat_ws(", ", listed[F.col("variable")]))).otherwise(""),
                F.lit(" ) {\n"), F.col("body"), F.lit("\n}"),
            ).alias("block"),
        )
    )
    heads = names.select(
        "network", "variable",
        F.concat(
            F.lit("variable "), F.col("variable"), F.lit(" {\n  type discrete [ "), F.size("names").cast("string"),
            F.lit(" ] { "), F.concat_ws(", ", "names"), F.lit(" };\n}"),
        ).alias("block"),
    )
    parts = heads.withColumn("part", F.lit(0)).unionByName(lines.withColumn("part", F.lit(1)))
    blocks = F.transform(
        F.sort_array(F.collect_list(F.struct("part", order[F.col("variable")].alias("o"), "block"))), lambda x: x["block"]
    )
    return parts.groupBy("network").agg(
        F.concat(F.lit("network unknown {\n}\n"), F.concat_ws("\n", blocks), F.lit("\n")).alias("text")
    )
