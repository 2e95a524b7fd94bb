"""Readers and writers: trace logs, string dictionaries, function facts, corpora, entity tables, whitelists."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemine.operators.ordered import shared_folder, sum_so_far
from tracemine.schemas import KINDS, PLOG

#: One function fact per row; exactly one of the structs is set.
FACTS = (
    "fun STRUCT<name: STRING, start: STRING, `end`: STRING, hasbody: BOOLEAN, fundecl: STRUCT<extern: BOOLEAN, ret_type: STRING, params: ARRAY<STRUCT<param: STRING>>>>, "
    "call STRUCT<name: STRING, containing_function: STRING, start: STRING, `end`: STRING, fnptr: BOOLEAN, ret_type: STRING, args: ARRAY<STRUCT<arg: STRUCT<name: STRING, type: STRING, info: STRING>>>>, "
    "fnPtrAssign STRUCT<name: STRING, start: STRING, `end`: STRING, fundecl: STRUCT<extern: BOOLEAN, ret_type: STRING, params: ARRAY<STRUCT<param: STRING>>>>"
)


def read_trace_log(spark: SparkSession, path: str, fmt: str = "jsonl") -> DataFrame:
    """The entries of the logs at path with ``trace_id`` (the file), ``seq`` (their order in it) and ``kind``.

    fmt ``jsonl`` has an entry per line, ``json_array`` one array of objects per file; both are read in parallel, also within a file. For lines seq grows in file order but is not dense:
    it is the place of the split in its file, and the place of the entry in the split. For arrays it is the entry's number. Lines that are not JSON objects of the schema have kind null, and so have such objects of an array.
    """
    if fmt == "json_array":
        return _with_kind(read_json_array(spark, path))
    if fmt != "jsonl":
        raise ValueError(f"fmt is jsonl or json_array, not {fmt}")
    rows = spark.read.schema(PLOG).json(path).select("*", F.col("_metadata.file_path").alias("trace_id"), _place().alias("seq"))
    return _with_kind(rows)


def _place():
    """Grows in the order of a file: the place of the split, and the place of the row in the partition, where it grows by one with each row."""
    return F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


#: Fixed patterns: what follows a backslash; a string of JSON, or the rest of a text in which one is not closed; what precedes the next object of an array.
_ESCAPED, _STRING, _BETWEEN = r"\\.", r'"[^"]*+(?:"|\z)', r'^(?:[^{"]++|"(?:[^"\\]++|\\.)*+")*+'


def read_json_array(spark: SparkSession, path: str, schema: str = PLOG) -> DataFrame:
    """The objects in the root arrays of the files at path: the columns of schema, ``trace_id`` (the file) and ``seq`` (the object's number in it, from 0 on).

    A file is read as pieces that end with a closing brace, wherever that stands, so byte ranges of one file are read by several tasks. A quote without a backslash opens or closes a string; so
    how many of them there were before a piece tells whether it begins in a string, and with that its braces and brackets outside of strings, how deep it ends. Both are sums over
    ordered ranges, as is the number of pieces that ended an object of the root array before, which puts an object's pieces together. Elements that are not objects are left out; an object that does not fit the schema is null in all columns.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("trace_id"), _place().alias("at"), "value")
    # what is escaped holds no quote that counts, and no brace
    bare = F.regexp_replace("value", _ESCAPED, "")
    inside = F.concat(F.lit('"'), bare)  # as it reads if it begins in a string
    outside = lambda text: F.regexp_replace(text, _STRING, "")
    many = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    # whether the brace that ends a piece closes an object depends on whether the piece ends in a string
    quotes, odd = many(bare, '"'), lambda n: n % 2 == 1
    depth = lambda text, n: many(outside(text), "{[") - many(outside(text), "]") - F.when(odd(n), 0).otherwise(1)
    slim = pieces.select("trace_id", "at", quotes.alias("quotes"), depth(bare, quotes).alias("plain"), depth(inside, quotes + 1).alias("quoted"))
    known = sum_so_far(slim, ["trace_id"], "at", F.col("quotes"), "before")
    known = known.select("trace_id", "at", F.when(odd(F.col("before")), F.col("quoted")).otherwise(F.col("plain")).alias("step"), odd(F.col("before") + F.col("quotes")).alias("open"))
    level = sum_so_far(known, ["trace_id"], "at", F.col("step"), "level")
    ends = level.select("trace_id", "at", ((F.col("level") + F.col("step") == 1) & ~F.col("open")).alias("ends"))
    numbered = sum_so_far(ends, ["trace_id"], "at", F.col("ends").cast("int"), "seq").select("trace_id", "at", "seq", "ends")
    parts = pieces.join(numbered, ["trace_id", "at"]).groupBy("trace_id", "seq").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"), F.max("ends").alias("whole"))
    text = F.regexp_replace(F.concat(F.array_join(F.col("p.value"), "}"), F.lit("}")), _BETWEEN, "")
    return parts.where("whole").select(F.from_json(text, schema).alias("o"), "trace_id", "seq").select("o.*", "trace_id", "seq")


def _with_kind(log: DataFrame) -> DataFrame:
    return log.withColumn("kind", F.coalesce(*(F.when(F.col(k).isNotNull(), k) for k in KINDS)))


def read_string_dict(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``value`` from lines ``id<tab>value``, split at the first tab; lines without a tab or with a bad id are dropped."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].try_cast("int").alias("id"), F.get(parts, F.lit(1)).alias("value")).where("id IS NOT NULL AND value IS NOT NULL")


def write_string_dict(df: DataFrame, path: str) -> None:
    """Writes ``id<tab>value`` lines in the order of id: files, and lines in them, are in order."""
    df.orderBy("id").select(F.concat_ws("\t", F.col("id").cast("string"), "value").alias("value")).write.mode("overwrite").text(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the place of each row in the order of ``order``, from 0 on.

    Rows are put in order by range partitions and numbered within each; only the partitions' counts meet in one task. The placed rows are written to the
    checkpoint folder: counts and rows are two uses of them, and range bounds are drawn anew each time that a partitioning is evaluated.
    """
    shared_folder(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    before = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return placed.join(F.broadcast(before), "__part").withColumn(name, rank + F.col("__before")).drop("__part", "__before")  # before has a row per partition


def extend_string_dict(known: DataFrame, strings: DataFrame) -> DataFrame:
    """known (``id``, ``value``) and, with the next dense ids, the strings (``value``, ``seq``) that it lacks, in the order in which they are first seen.

    Ids must be dense, so new strings are counted by range partition first; only the partitions' counts meet in one task.
    """
    new = strings.groupBy("value").agg(F.min("seq").alias("seq")).join(known.select("value"), "value", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    return known.unionByName(numbered(new, ["seq", "value"], "rank").select((F.col("rank") + top + 1).cast("int").alias("id"), "value"))


def read_function_facts(spark: SparkSession, path: str, fmt: str = "jsonl") -> dict[str, DataFrame]:
    """Tables ``fun``, ``call`` and ``fn_ptr_assign``. Functions whose start is their end are dropped; ``filename`` is what precedes the first colon of start.

    fmt ``yaml`` reads files that hold a JSON or YAML list of facts each, if a YAML parser is installed.
    """
    if fmt == "yaml":
        raw = spark.read.text(path, wholetext=True).mapInPandas(_yaml_lines, "value string")
        facts = raw.select(F.from_json("value", FACTS).alias("f")).select("f.*")
    else:
        facts = spark.read.schema(FACTS).json(path)
    fun = facts.where("fun IS NOT NULL AND fun.start <> fun.end").select("fun.*", F.split("fun.start", ":")[0].alias("filename"))
    return {"fun": fun, "call": facts.where("call IS NOT NULL").select("call.*"), "fn_ptr_assign": facts.where("fnPtrAssign IS NOT NULL").select("fnPtrAssign.*")}


def _yaml_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def entries(text: str) -> list:
        try:
            return json.loads(text)
        except ValueError:
            import yaml  # optional

            return yaml.safe_load(text) or []

    for b in batches:
        yield pd.DataFrame({"value": [json.dumps(x) for t in b["value"] for x in entries(t)]}, dtype="object")


def read_compile_commands(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Distinct source directories (``dir``) and full paths of C files (``path``) of a compile_commands.json."""
    rows = spark.read.schema("directory STRING, file STRING").option("multiLine", True).json(path)
    full = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    return rows.select(F.col("directory").alias("dir")).distinct(), rows.where(F.col("file").endswith(".c")).select(full.alias("path")).distinct()


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Seed inputs as bytes: ``name``, ``content``, ``length``."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content", "length")


def write_entities(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table each, partitioned by input file where there is one."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("inputfile") if "inputfile" in df.columns else writer).parquet(f"{path}/{name}")


def read_entities(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key: a partial aggregate on both sides of one shuffle, without a sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")) if rest else df.select(*keys).distinct()
    return picked.select(*keys, *(F.col(f"__first.{c}").alias(c) for c in rest)).select(*df.columns)


def upsert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Get-or-create: existing rows stay, and each new key gets its first incoming row. Null keys equal each other."""
    first = first_by(incoming, keys, order)
    names = existing.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return existing.unionByName(first.join(names, same, "left_anti").select(*existing.columns))


def write_whitelist(df: DataFrame, path: str) -> None:
    """Lines ``NOFILENAME tag function`` of rows ``tag``, ``function``."""
    df.select(F.concat_ws(" ", F.lit("NOFILENAME"), "tag", "function").alias("value")).write.mode("overwrite").text(path)


#: Fixed pattern: a whitelist line's tag and function.
WHITELIST = r"^\s*\S+\s+(df|root|addvar)\s+(\S+)\s*$"


def parse_whitelist(lines: DataFrame) -> DataFrame:
    """Distinct ``tag``, ``function`` of whitelist lines (``value``); malformed ones are ignored."""
    return lines.where(F.col("value").rlike(WHITELIST)).select(F.regexp_extract("value", WHITELIST, 1).alias("tag"), F.regexp_extract("value", WHITELIST, 2).alias("function")).distinct()


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return parse_whitelist(spark.read.text(path))


def truncate_for_rerun(spark: SparkSession, path: str) -> None:
    """Before mining again, empties label sets and viable bytes; bugs and all other tables stay."""
    for name in ("label_set", "dua_viable_byte"):
        schema = spark.read.parquet(f"{path}/{name}").schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")
