"""The archive on disk: data by batch, and tables that describe it.

data       the rows, in folders of a few batches each (part), one dataset or one for each field
batches    batch_id, part, n_rec, first, last, fields: the fields that occur in the batch, by first appearance
fields     field_id, name, ptype, layout, transforms
schemas    schema_id, pattern, n_rows: the ordered field sets of rows
column_stats  batch_id, field, n_records, n_elements, n_null, min_v, max_v, u_sz, c_sz, md5
dictionaries  batch_id, field, code, value (as text)
blooms     batch_id, field, block, w0 to w7
encoded    batch_id, field, n_rec, keys, data, log: columns that went through transforms

A scan asks these tables which batches can hold what it wants, and reads their folders only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators import bloom, dictionary, pipeline, schema, stats

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_OWN = ("batch_id", "_ordinal", "_schema_id", "part")
#: Batches in a folder; bits of a batch's Bloom filter.
PART, BLOOM_BITS = 16, 4096
#: Up to so many surviving batches, their numbers come to the driver and select folders; beyond, they are joined.
MAX_LISTED = 100_000


def write(batched: DataFrame, path: str, pattern: Column | None = None, dictionaries: tuple[str, ...] = (), blooms: tuple[str, ...] = (), transforms: dict[str, tuple[str, ...]] | None = None, split: bool = False, part: int = PART, bloom_bits: int = BLOOM_BITS) -> None:
    """Writes a table with batch_id and _ordinal, and what describes it.

    pattern: each row's ordered field names; rows then carry a _schema_id. Without it every row has all
    columns. transforms: by field, what its encoded form goes through (none named: chosen by batch). An
    empty table has empty tables. The rows are worked out once and stored; everything is made from that copy,
    which goes in the end.
    """
    spark, transforms = batched.sparkSession, transforms or {}
    names = [c for c in batched.columns if c not in _OWN]
    kinds = {f.name: f.dataType for f in batched.schema.fields}
    rows = batched.withColumn("pattern", pattern if pattern is not None else F.array(*[F.lit(c) for c in names]).cast("array<string>"))
    staged = f"{path}/_rows"
    rows.write.parquet(staged, compression="zstd")
    rows = spark.read.schema(rows.schema).parquet(staged)
    batched = rows.drop("pattern")
    schemas = schema.schema_ids(rows, F.col("pattern"), "_ordinal")
    schemas.write.parquet(f"{path}/schemas")
    known = spark.read.parquet(f"{path}/schemas").select("pattern", "schema_id")
    data = rows.join(known, "pattern").withColumnRenamed("schema_id", "_schema_id").withColumn("part", F.floor(F.col("batch_id") / part).cast("int"))
    out = data.drop("pattern").repartitionByRange("batch_id").sortWithinPartitions("part", "batch_id", "_ordinal")
    for folder, columns in [(f"data/{c}", [c]) for c in names] if split else [("data", names)]:
        out.select("part", "batch_id", "_ordinal", "_schema_id", *columns).write.partitionBy("part").parquet(f"{path}/{folder}", compression="zstd")

    local = schema.local_fields(rows, F.col("pattern"), "_ordinal").groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("local_id", "field"))), lambda x: x["field"]).alias("fields"))
    sums = batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rec"), F.min("_ordinal").alias("first"), F.max("_ordinal").alias("last"))
    sums.join(local, "batch_id", "left").withColumn("part", F.floor(F.col("batch_id") / part).cast("int")).write.parquet(f"{path}/batches")

    layout = lambda c: "TENSOR" if isinstance(kinds[c], (T.ArrayType, T.StringType)) else "COLUMN"
    listed = [(i, c, kinds[c].simpleString(), layout(c), list(transforms.get(c, ()))) for i, c in enumerate(names)]
    spark.createDataFrame(listed, "field_id int, name string, ptype string, layout string, transforms array<string>").coalesce(1).write.parquet(f"{path}/fields")

    logs = None
    if transforms:
        pipeline.encode_all(batched, transforms).sortWithinPartitions("field", "batch_id").write.parquet(f"{path}/encoded")
        e = F.col("log")
        logs = spark.read.parquet(f"{path}/encoded").select("batch_id", "field", e[0]["u_sz"].alias("u_sz"), F.octet_length("data").cast("bigint").alias("c_sz"), e[0]["md5"].alias("md5"))
    found = stats.column_stats(batched, names)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("u_sz", "bigint"), ("c_sz", "bigint"), ("md5", "string"))]
    (found.join(logs, ["batch_id", "field"], "left") if logs is not None else found.select("*", *none)).write.parquet(f"{path}/column_stats")
    for c in dictionaries:
        own = dictionary.dictionary(batched, c, "_ordinal")
        own.select("batch_id", F.lit(c).alias("field"), "code", F.col(c).cast("string").alias("value")).write.mode("append").parquet(f"{path}/dictionaries")
    for c in blooms:
        bloom.build(batched, c, bloom_bits, ["batch_id"]).select("batch_id", F.lit(c).alias("field"), "block", *[f"w{i}" for i in range(8)]).write.mode("append").parquet(f"{path}/blooms")
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the archive's tables; one that was not written has no rows."""
    if name in _folders(spark, path):
        return spark.read.parquet(f"{path}/{name}")
    empty = {"dictionaries": "batch_id int, field string, code int, value string", "blooms": "batch_id int, field string, block int, " + ", ".join(f"w{i} bigint" for i in range(8)), "encoded": f"batch_id int, field string, n_rec bigint, keys array<bigint>, data binary, log {pipeline.LOG}"}
    return spark.createDataFrame([], empty[name])


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The folders below a path of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return [s.getPath().getName() for s in found if s.isDirectory() and not s.getPath().getName().startswith("_")]


def read(spark: SparkSession, path: str, fields: list[str] | None = None, parts: list[int] | None = None) -> DataFrame:
    """The table back, or only some of its fields, or of its folders."""
    kinds = {r["name"]: r["ptype"] for r in table(spark, path, "fields").orderBy("field_id").collect()}
    split = [f for f in _folders(spark, f"{path}/data") if not f.startswith("part=")]
    want = fields if fields is not None else list(kinds)
    keys = {"part": "int", "batch_id": "int", "_ordinal": "bigint", "_schema_id": "int"}

    def one(folder: str, columns: list[str]) -> DataFrame:
        # The schema is told, as an empty table has no file to take it from.
        known = T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in (*((c, kinds[c]) for c in columns), *keys.items())])
        rows = spark.read.schema(known).parquet(f"{path}/{folder}").select(*keys, *columns)
        return rows if parts is None else rows.where(F.col("part").isin(parts)) if parts else rows.where("false")

    if not split:
        return one("data", want)
    return reduce(lambda a, b: a.join(b, list(keys)), [one(f"data/{c}", [c]) for c in want or split[:1]]).select(*keys, *want)


def surviving(spark: SparkSession, path: str, ranges: dict[str, tuple[float, float]] | None = None, members: dict[str, object] | None = None, hashed: dict[str, object] | None = None, having: tuple[str, ...] = (), bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """batch_id, part of the batches that no stored table rules out.

    ranges: field -> closed interval, by minimum and maximum; members: field -> value, by dictionaries;
    hashed: field -> value, by Bloom filters; having: fields that some row must have. Fields of which
    nothing is stored rule nothing out.
    """
    batches = table(spark, path, "batches")
    for f in having:
        batches = batches.where(F.array_contains("fields", f))
    out = batches.select("batch_id", "part")
    if ranges:
        found = table(spark, path, "column_stats").where(F.col("field").isin(list(ranges)))
        outside = reduce(lambda a, b: a | b, [(F.col("field") == f) & ~stats.overlaps(F.col("min_v"), F.col("max_v"), a, b, F.col("n_null"), F.col("n_records")) for f, (a, b) in ranges.items()])
        out = out.join(found.where(outside).select("batch_id"), "batch_id", "left_anti")
    for f, value in (members or {}).items():
        own = table(spark, path, "dictionaries").where(F.col("field") == f)
        found = own.groupBy("batch_id").agg(F.count_if(F.col("value") == F.lit(value).cast("string")).alias("n"))
        out = out.join(found.where("n = 0").select("batch_id"), "batch_id", "left_anti")
    for f, value in (hashed or {}).items():
        kind = next(r["ptype"] for r in table(spark, path, "fields").where(F.col("name") == f).collect())
        own = table(spark, path, "blooms").where(F.col("field") == f)
        may = bloom.holding(own, value, kind, bloom_bits, ["batch_id"])
        sure = own.select("batch_id").distinct().join(may, "batch_id", "left_anti")
        out = out.join(sure, "batch_id", "left_anti")
    return out


def scan(spark: SparkSession, path: str, exact: Column | None = None, fields: list[str] | None = None, **tests) -> DataFrame:
    """The rows that satisfy the exact predicate, from the folders of batches that survive the tests of surviving()."""
    left = surviving(spark, path, **tests)
    listed = left.limit(MAX_LISTED + 1).collect()
    few = len(listed) <= MAX_LISTED
    rows = read(spark, path, fields, sorted({r["part"] for r in listed}) if few else None)
    if few and len(listed) <= 1000:
        rows = rows.where(F.col("batch_id").isin([r["batch_id"] for r in listed])) if listed else rows
    else:
        rows = rows.join(F.broadcast(left.select("batch_id")) if few else left.select("batch_id"), "batch_id", "left_semi")
    if having := tests.get("having"):
        schemas = table(spark, path, "schemas").where(reduce(lambda a, b: a & b, [F.array_contains("pattern", f) for f in having]))
        rows = rows.join(F.broadcast(schemas.select(F.col("schema_id").alias("_schema_id"))), "_schema_id", "left_semi")
    return rows if exact is None else rows.where(exact)


def decoded(spark: SparkSession, path: str, *fields: str) -> DataFrame:
    """batch_id, _ordinal and fields from their encoded forms, checksums verified."""
    listed = {r["name"]: r["ptype"] for r in table(spark, path, "fields").where(F.col("name").isin(list(fields))).collect()}
    kinds = {f: T._parse_datatype_string(listed[f]) for f in fields}
    blocks = table(spark, path, "encoded")
    if len(fields) == 1:
        return pipeline.decode(blocks.where(F.col("field") == fields[0]), fields[0], kinds[fields[0]])
    return pipeline.decode_all(blocks, kinds)


def describe(spark: SparkSession, path: str) -> DataFrame:
    """field, ptype, layout, transforms, n (valid rows), n_batches, u_sz, c_sz and fold, from the stored tables; sizes are 0 where nothing was encoded."""
    sums = table(spark, path, "column_stats").groupBy("field").agg(F.sum(F.col("n_records") - F.col("n_null")).alias("n"), F.count(F.lit(1)).alias("n_batches"), F.coalesce(F.sum("u_sz"), F.lit(0)).alias("u_sz"), F.coalesce(F.sum("c_sz"), F.lit(0)).alias("c_sz"))
    fields = table(spark, path, "fields").select(F.col("name").alias("field"), "ptype", "layout", F.when(F.size("transforms") > 0, F.array_join("transforms", ",")).otherwise("AUTO").alias("transforms"))
    return fields.join(sums, "field").withColumn("fold", F.coalesce(F.try_divide("u_sz", "c_sz"), F.lit(0.0)))
