"""The queries of the catalogue; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import codecs, text
from lodestrata.operators import arrays, batching, bloom, dictionary, pipeline, schema, stats, transforms
from lodestrata.sources import archive, fastq, sam, vcf
from lodestrata.sources import text as lines
from lodestrata.sources.scratch import new_path

#: Rows in a batch of the catalogue.
SIZE = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return batching.assign_batches(events.select("event_id", *columns), "event_id", SIZE)


#: By application and folder, the archive of its events: they are taken in once, and all queries read that.
_archives: dict[tuple[str, str], str] = {}


def _archive(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _archives:
        path = new_path(spark, "events-archive")
        rows = _events(spark, sf_dir, "user_id", "event_type", "value", "props")
        archive.write(rows, path, pattern=_fields(rows, "user_id"), dictionaries=("event_type",), blooms=("user_id",), transforms={"event_type": (), "user_id": ("DELTA", "ZSTD"), "value": ("ZSTD",), "props": ("RC_ILLUMINA_NAME",)})
        _archives[key] = path
    return _archives[key]


def _written(df: DataFrame, line) -> str:
    """A folder of text files with a line for each row."""
    path = new_path(df.sparkSession, "text")
    df.select(line.alias("value")).write.text(path)
    return path


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.gathered(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "roles")


def batch_assign(spark, sf_dir):
    return batching.batch_summary(_events(spark, sf_dir), "event_id")


def segment_stats(spark, sf_dir):
    return stats.segment_stats(_events(spark, sf_dir, "value", "user_id"), ["value", "user_id"])


def segment_overlap(spark, sf_dir):
    found = stats.segment_stats(_events(spark, sf_dir, "value"), ["value"])
    return found.select("batch_id", stats.overlaps(F.col("min_v"), F.col("max_v"), 500, 400, F.col("n_null"), F.col("n_records")).alias("overlaps"))


def range_scan(spark, sf_dir, low, high):
    """The events whose value lies between low and high, from the archive's batches that can hold such."""
    return archive.scan(spark, _archive(spark, sf_dir), F.col("value").between(low, high), ranges={"value": (low, high)}).select("event_id", "user_id", "event_type", "value")


def pruned_range_scan(spark, sf_dir):
    return range_scan(spark, sf_dir, 400, 500)


def dict_encode_scalar(spark, sf_dir):
    return dictionary.encode(_events(spark, sf_dir, "event_type"), "event_type", "_ordinal").select("event_id", "batch_id", "code")


def dict_values(spark, sf_dir):
    return dictionary.dictionary(_events(spark, sf_dir, "event_type"), "event_type", "_ordinal")


def dict_decision(spark, sf_dir):
    return dictionary.decision(_events(spark, sf_dir, "event_type"), ["event_type", "event_id"])


def dict_contains(spark, sf_dir):
    return dictionary.contains(dictionary.dictionary(_events(spark, sf_dir, "user_id"), "user_id", "_ordinal"), "user_id", 7)


def dict_roundtrip(spark, sf_dir):
    rows = _events(spark, sf_dir, "event_type")
    coded = dictionary.encode(rows, "event_type", "_ordinal").select("event_id", "batch_id", "code", F.col("event_type").isNotNull().alias("valid"))
    return dictionary.decode(coded, dictionary.dictionary(rows, "event_type", "_ordinal"), "event_type", F.col("valid")).select("event_id", "event_type")


def tensor_dict_encode(spark, sf_dir):
    return dictionary.encode(_roles(spark, sf_dir), "roles", "conv_id", None).select("conv_id", "code", F.array_join("roles", ",").alias("roles"))


def tensor_contains_any(spark, sf_dir):
    return _roles(spark, sf_dir).select("conv_id", dictionary.any_element(F.col("roles"), "user").alias("matches"))


def tensor_contains_exact(spark, sf_dir):
    return _roles(spark, sf_dir).select("conv_id", dictionary.equals_array(F.col("roles"), ["user", "assistant"]).alias("is_match"))


def tensor_offsets(spark, sf_dir):
    sizes = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return arrays.offsets(sizes, "conv_id", F.col("n"))


def tensor_explode(spark, sf_dir):
    return arrays.elements(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def tensor_stats(spark, sf_dir):
    return stats.tensor_stats(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def column_split(spark, sf_dir):
    return arrays.split_columns(_roles(spark, sf_dir), "roles", "role")


def _orders(spark, sf_dir):
    return batching.assign_batches(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", SIZE)


def delta_encode(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", "batch_id", transforms.delta("o_custkey", "o_orderkey").alias("delta"))


def delta_roundtrip(spark, sf_dir):
    coded = _orders(spark, sf_dir).withColumn("delta", transforms.delta("o_custkey", "o_orderkey")).select("o_orderkey", "batch_id", "delta")
    return coded.select("o_orderkey", transforms.prefix_sum("delta", "o_orderkey").alias("decoded"))


def delta_delta(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return transforms.difference(orders, "o_custkey", "o_orderkey", "dd", times=2).select("o_orderkey", "dd")


def null_pad_union(spark, sf_dir):
    return batching.null_padded_union(_table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region"))


def _fields(events: DataFrame, second: str = "ts"):
    """The fields that a row of events carries: value for purchases, props for errors."""
    extra = F.when(F.col("event_type") == "purchase", F.array(F.lit("value"))).when(F.col("event_type") == "error", F.array(F.lit("props"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("event_id"), F.lit(second)), extra)


def schema_patterns(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return schema.schema_ids(events, _fields(events), "event_id").withColumn("pattern", F.array_join("pattern", ","))


def schema_filter(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn("pattern", _fields(_table(spark, sf_dir, "events")))
    schemas = schema.schema_ids(events, F.col("pattern"), "event_id")
    rows = events.join(schemas.select("pattern", "schema_id"), "pattern")
    return schema.rows_with(rows, schemas, "value").select("event_id", "value")


def batch_local_fields(spark, sf_dir):
    rows = _events(spark, sf_dir, "event_type")
    return schema.local_fields(rows, _fields(rows), "event_id")


def field_occurrences(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    own = events.select(F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"), F.when(F.col("event_type") == "error", F.col("props")).alias("props"))
    return stats.occurrences(own, ["value", "props"])


def bloom_semi(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return bloom.semi_join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", customers, "c_custkey")


def bloom_sizing(spark, sf_dir):
    ndv = _table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").alias("ndv")).first()["ndv"]
    return spark.range(1).select(F.lit(ndv).cast("long").alias("ndv"), F.lit(bloom.optimal_bits(ndv, 0.05)).cast("long").alias("num_bits"))


def prune_cascade(spark, sf_dir):
    exact = (F.col("event_type") == "error") & (F.col("user_id") == 13) & (F.col("value") >= 50)
    kept = archive.scan(spark, _archive(spark, sf_dir), exact, ranges={"value": (50, float("inf"))}, members={"event_type": "error"}, hashed={"user_id": 13})
    return kept.select("event_id", "user_id", "event_type", "value")


def md5_checksum(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", transforms.checksum(F.col("text")).alias("digest"))


def batch_checksum(spark, sf_dir):
    return transforms.batch_checksum(_events(spark, sf_dir, "event_type"), "event_type", "event_id")


def string_split(spark, sf_dir):
    parts = text.string_split(F.col("url"), ":/?&=.")
    return _table(spark, sf_dir, "pages").select("page_id", F.size(parts).alias("n_tokens"), F.array_join(parts, "|").alias("tokens"))


def tag_parse(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    written = F.array(F.concat(F.lit("UI:i:"), F.col("user_id").cast("string")), F.concat(F.lit("ET:Z:"), F.col("event_type")))
    return events.select("event_id", F.explode(written).alias("t")).select("event_id", text.tag(F.col("t")).alias("t")).select("event_id", "t.*")


def string_dict(spark, sf_dir):
    return text.string_dictionary(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


def base_2bit(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", transforms.bases(F.col("text")).alias("seq"))
    return transforms.two_bit(docs, "seq").select("doc_id", "n_bases", "codes", "n_masked")


def describe_fields(spark, sf_dir):
    fields = {"event_id": ("INT64", "COLUMN"), "value": ("DOUBLE", "COLUMN"), "event_type": ("UINT8", "TENSOR")}
    return stats.field_report(_events(spark, sf_dir, "value", "event_type"), fields)


def sha512(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", transforms.sha512(F.col("text")).alias("digest"))


def archive_read(spark, sf_dir):
    return archive.read(spark, _archive(spark, sf_dir), ["event_id", "user_id", "event_type", "value"]).select("event_id", "user_id", "event_type", "value", "_schema_id")


def archive_batches(spark, sf_dir):
    return archive.table(spark, _archive(spark, sf_dir), "batches").select("batch_id", "n_rec", "first", "last", F.array_join("fields", ",").alias("fields"))


def archive_fields(spark, sf_dir):
    return archive.table(spark, _archive(spark, sf_dir), "fields").select("field_id", "name", "ptype", "layout", F.array_join("transforms", ",").alias("transforms"))


def archive_schemas(spark, sf_dir):
    return archive.table(spark, _archive(spark, sf_dir), "schemas").withColumn("pattern", F.array_join("pattern", ","))


def archive_stats(spark, sf_dir):
    return archive.table(spark, _archive(spark, sf_dir), "column_stats").drop("u_sz", "c_sz", "md5")


def archive_dictionaries(spark, sf_dir):
    return archive.table(spark, _archive(spark, sf_dir), "dictionaries")


def archive_sizes(spark, sf_dir):
    return archive.table(spark, _archive(spark, sf_dir), "column_stats").where("field in ('event_type', 'props')").select("batch_id", "field", "u_sz", "md5", (F.col("c_sz") < F.col("u_sz")).alias("smaller"))


def archive_describe(spark, sf_dir):
    return archive.describe(spark, _archive(spark, sf_dir)).select("field", "ptype", "layout", "transforms", "n", "n_batches", "u_sz", (F.col("fold") > 1).alias("folds"))


def archive_decoded(spark, sf_dir):
    return archive.decoded(spark, _archive(spark, sf_dir), "event_type", "user_id", "props")


def archive_having(spark, sf_dir):
    return archive.scan(spark, _archive(spark, sf_dir), having=("value",)).select("event_id", "value")


def archive_split(spark, sf_dir):
    path = new_path(spark, "split")
    archive.write(batching.assign_batches(_table(spark, sf_dir, "customer"), "c_custkey", SIZE), path, split=True)
    return archive.read(spark, path, ["c_custkey", "c_name", "c_acctbal"]).select("batch_id", "c_custkey", "c_name", "c_acctbal")


def bloom_by_batch(spark, sf_dir):
    """Whether each batch's stored filter tells of the user that it surely has: its first one."""
    path = _archive(spark, sf_dir)
    rows = archive.read(spark, path, ["user_id"]).groupBy("batch_id").agg(F.min_by("user_id", "_ordinal").alias("user_id"))
    sieve = archive.table(spark, path, "blooms").where("field = 'user_id'").withColumnRenamed("batch_id", "b")
    found = bloom.probe(rows, "user_id", sieve, archive.BLOOM_BITS, F.col("b") == F.col("batch_id"))
    return found.select("batch_id", "user_id")


def transform_roundtrip(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    coded = pipeline.encode(rows, "o_custkey", ["DELTA_DELTA", "DICT", "ZSTD"])
    back = pipeline.decode(coded, "o_custkey", rows.schema["o_custkey"].dataType)
    return back.select("batch_id", F.col("_ordinal").alias("ordinal"), "o_custkey")


def transform_log(spark, sf_dir):
    logs = pipeline.log_table(pipeline.encode(_orders(spark, sf_dir), "o_custkey", ["DELTA", "ZSTD"]))
    return logs.select("batch_id", "step", "transform", "u_sz", F.when(F.col("transform") != "ZSTD", F.col("c_sz")).alias("plain_sz"), (F.length("md5") == 32).alias("has_md5"))


def auto_transform(spark, sf_dir):
    rows = _events(spark, sf_dir, "event_type", "user_id")
    both = pipeline.encode(rows, "event_type").unionByName(pipeline.encode(rows, "event_id")).unionByName(pipeline.encode(rows, "user_id"))
    return both.select("batch_id", "field", "n_rec", F.array_join(F.transform("log", lambda e: e["transform"]), ",").alias("transforms"))


def transform_orders(spark, sf_dir):
    named = [([], ), (["ZSTD"], ), (["DICT", "ZSTD"], ), (["DICT", "ZSTD", "RC_BASES"], ), (["AUTO"], ), (["DICT", "DICT"], ), (["ZSTD", "DICT"], ), (["DICT", "DELTA"], ), (["AUTO", "DICT", "RC_QUAL"], )]
    return spark.createDataFrame([(",".join(n), transforms.valid_order(n)) for (n,) in named], "transforms string, valid boolean")


def _through(rows: DataFrame, codec: str) -> DataFrame:
    """doc_id and the MD5 of v, of rows that went through a codec and back."""
    return codecs.decompress(codecs.compress(rows, "v", codec, "doc_id"), "v", "doc_id").select("doc_id", F.md5(F.col("v").cast("binary")).alias("digest"))


def quality_codec(spark, sf_dir):
    return _through(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("v")), "RC_QUAL")


def base_codec(spark, sf_dir):
    return _through(_table(spark, sf_dir, "documents").select("doc_id", transforms.bases(F.col("text")).alias("v")), "RC_BASES")


def name_codec(spark, sf_dir):
    return _through(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("v")), "RC_ILLUMINA_NAME")


def plain_codec(spark, sf_dir):
    return _through(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("v")), "ZSTD")


def pack_bases(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", transforms.bases(F.col("text")).alias("seq"))
    back = transforms.unpack_bases(transforms.pack_bases(docs, "seq"), "back")
    return back.select("doc_id", "n_bases", F.octet_length("packed").alias("n_bytes"), F.size("other").alias("n_other"), F.md5(F.col("back").cast("binary")).alias("digest"))


def fastq_scan(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    bases = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "ACGTNACGTN")
    path = _written(orders, F.concat(F.lit("@r."), F.col("o_orderkey").cast("string"), F.lit(" L:1/2\n"), bases, F.lit("\n+\n"), F.lpad(F.col("o_custkey").cast("string"), 8, "I")))
    found = fastq.scan(spark, path)
    return found.select("name", F.array_join(fastq.name_parts(F.col("name")), "|").alias("parts"), "BASES", "QUAL")


def _sam(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    text = lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("ST:"), text("o_orderkey"), F.lit(":H0:1:2:3:"), text("o_custkey"))
    row = F.concat_ws("\t", name, F.lit("99"), F.col("o_orderstatus"), text("o_orderkey"), F.lit("60x"), F.lit("8M"), F.col("o_orderpriority"), F.lit("-7"), F.lit("+12"), F.lit("ACGT"), F.lit("IIII"), F.concat(F.lit("NM:i:-"), text("o_custkey")), F.lit("RG:Z:a:b"))
    return sam.scan(spark, _written(o, row))


def sam_scan(spark, sf_dir):
    return _sam(spark, sf_dir).select(*[F.col(n).alias(n.replace("-", "_")) for n, _ in sam.NAME_PARTS], "FLAG", "RNAME", "POS", "MAPQ", "CIGAR", "RNEXT", "PNEXT", "TLEN", "BASES", "QUAL")


def sam_tags(spark, sf_dir):
    return sam.tag_columns(_sam(spark, sf_dir), {"NM": "i", "RG": "Z", "XX": "f"}).select("POS", "NM", "RG", "XX")


def sam_reference_ids(spark, sf_dir):
    return sam.with_reference_ids(_sam(spark, sf_dir), "POS").select("POS", "RNAME_id", "RNEXT_id")


def _vcf(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    calls = [F.concat((n % 3).cast("string"), F.lit("|"), F.when(n % 5 == 0, ".").otherwise("1"), F.lit(":9")), F.concat(F.lit("0/"), (n % 2).cast("string"))]
    row = F.concat_ws("\t", F.col("p_brand"), n.cast("string"), F.concat(F.lit("rs"), n.cast("string")), F.lit("A"), F.lit("C,G"), F.when(n % 4 == 0, ".").otherwise(F.concat((n % 90).cast("string"), F.lit(".5"))), F.when(n % 2 == 0, "PASS").otherwise("q10"), F.concat(F.lit("DP="), F.col("p_size").cast("string"), F.lit(";DB;X=a=b")), F.lit("GT:DP"), *calls)
    return vcf.scan(spark, _written(p, row))


def vcf_scan(spark, sf_dir):
    get = lambda k: F.try_element_at("INFO", F.lit(k))
    return vcf.with_ids(_vcf(spark, sf_dir), "POS").select("RNAME", "RNAME_id", "POS", "NAME", "REF", "ALT", "QUAL", "FILTER", "FILTER_id", get("DP").alias("dp"), get("DB").alias("db"), get("X").alias("x"))


def vcf_genotypes(spark, sf_dir):
    rows = _vcf(spark, sf_dir)
    long = vcf.genotypes(rows)
    return rows.select("path", "line_no", "POS").join(long, ["path", "line_no"]).select("POS", "sample", "hap", "allele")


def vcf_columns(spark, sf_dir):
    return vcf.genotype_columns(_vcf(spark, sf_dir), 2).select("POS", *[F.col(f"GT-{k}").alias(f"gt_{k}") for k in range(4)])


def bed_scan(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    row = F.concat_ws("\t", F.col("o_orderstatus"), F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + 9).cast("string"), F.col("o_orderpriority"))
    return lines.tabular(spark, _written(o, row), "bed")


def _annotations(spark, sf_dir, kind):
    o = _table(spark, sf_dir, "orders")
    row = F.concat_ws("\t", F.col("o_orderstatus"), F.lit("src"), F.lit("gene"), F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + 5).cast("string"), F.lit("."), F.lit("+"), F.lit("0"), F.concat(F.lit("ID=g"), F.col("o_custkey").cast("string")))
    return lines.tabular(spark, _written(o, row), kind)


def gff3_scan(spark, sf_dir):
    return _annotations(spark, sf_dir, "gff3")


def gtf2_scan(spark, sf_dir):
    return _annotations(spark, sf_dir, "gtf2")


def fasta_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(transforms.bases(F.col("text")), F.lit("")).alias("seq"))
    half = F.floor(F.length("seq") / 2).cast("int")
    row = F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" x\n"), F.substring(F.col("seq"), F.lit(1), half), F.lit("\n"), F.substring(F.col("seq"), half + 1, F.length("seq")))
    return lines.fasta(spark, _written(docs, row)).select("name", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


def _built(spark, sf_dir):
    """Regions and nations as records of different fields, made one by one: 30 rows at any scale."""
    table = schema.TableBuilder(batch_size=7)
    table.set_field("name", "TEXT")
    for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        table.append(schema.RecordBuilder().add("region", "UINT8", r["r_regionkey"]).add("name", "TEXT", r["r_name"]))
    for n in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        keys = [n["n_nationkey"], n["n_regionkey"]]
        table.append(schema.RecordBuilder().add("name", "TEXT", n["n_name"]).add("keys", "INT32", *keys).add_array("pair", "INT64", keys))
    return table


def table_builder(spark, sf_dir):
    built = _built(spark, sf_dir).build(spark)
    return built.select(F.col("_ordinal").alias("ordinal"), F.col("_batch_id").alias("batch_id"), F.col("_schema_id").alias("schema_id"), "region", "name", "keys_0", "keys_1", F.array_join(F.col("pair").cast("array<string>"), ",").alias("pair"))


def table_fields(spark, sf_dir):
    return _built(spark, sf_dir).field_table(spark).drop("transforms")


def table_schemas(spark, sf_dir):
    return _built(spark, sf_dir).schemas(spark).withColumn("field_ids", F.array_join(F.col("field_ids").cast("array<string>"), ","))


def field_ids(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return schema.field_ids(events, _fields(events), "event_id")


def local_lookup(spark, sf_dir):
    rows = _events(spark, sf_dir, "event_type")
    local = schema.local_fields(rows, _fields(rows), "event_id").where("batch_id = 0")
    return spark.createDataFrame([(f, schema.local_id(local, 0, f)) for f in ("event_id", "ts", "nothing")], "field string, local_id int")


def tensor_null_pad(spark, sf_dir):
    rows = _roles(spark, sf_dir).withColumn("roles", F.when(F.col("conv_id") % 3 != 0, F.col("roles")))
    return arrays.offsets(rows, "conv_id", F.when(F.col("roles").isNotNull(), F.size("roles").cast("long")))


def compression_fold(spark, sf_dir):
    sizes = archive.table(spark, _archive(spark, sf_dir), "column_stats").where("u_sz is not null").withColumn("column_no", F.lit(0))
    return stats.compression_fold(sizes).select("field", "n_columns", "u_sz", (F.col("fold") > 1).alias("folds"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        batch_assign, segment_stats, segment_overlap, pruned_range_scan, dict_encode_scalar, dict_values, dict_decision, dict_contains, dict_roundtrip, tensor_dict_encode, tensor_contains_any,
        tensor_contains_exact, tensor_offsets, tensor_explode, tensor_stats, column_split, delta_encode, delta_roundtrip, delta_delta, null_pad_union, schema_patterns, schema_filter,
        batch_local_fields, field_occurrences, bloom_semi, bloom_sizing, prune_cascade, md5_checksum, batch_checksum, string_split, tag_parse, string_dict, base_2bit, describe_fields, sha512,
        archive_read, archive_batches, archive_fields, archive_schemas, archive_stats, archive_dictionaries, archive_sizes, archive_describe, archive_decoded, archive_having, archive_split, bloom_by_batch,
        transform_roundtrip, transform_log, auto_transform, transform_orders, quality_codec, base_codec, name_codec, plain_codec, pack_bases, fastq_scan, sam_scan, sam_tags, sam_reference_ids, vcf_scan,
        vcf_genotypes, vcf_columns, bed_scan, gff3_scan, gtf2_scan, fasta_scan, table_builder, table_fields, table_schemas, field_ids, local_lookup, tensor_null_pad, compression_fold,
    )
}
