import json
import os
import random

import numpy as np
import pytest
from lodestrata.functions import codecs, text
from lodestrata.operators import pipeline
from lodestrata.operators.batching import assign_batches
from lodestrata.sources import archive, fastq, sam, vcf
from lodestrata.sources import text as lines
from lodestrata.streaming import append
from pyspark.sql import functions as F


def test_string_split(spark):
    df = spark.createDataFrame([("a:b/:c:",), ("",), (None,), ("x-y]z",)], "t string")
    assert [r[0] for r in df.select(text.string_split(F.col("t"), ":/")).collect()] == [["a", "b", "c"], [], None, ["x-y]z"]]
    assert df.select(text.string_split(F.col("t"), ":/", True)).first()[0] == ["a", "b", "", "c"]
    assert [r[0] for r in df.select(text.string_split(F.col("t"), "-]")).collect()][3] == ["x", "y", "z"]


def test_numbers_and_tags(spark):
    df = spark.createDataFrame([("12x",), ("-7",), ("x",), ("",), ("1.5e2z",)], "t string")
    assert [r[0] for r in df.select(text.atoi(F.col("t"))).collect()] == [12, -7, 0, 0, 1]
    assert df.select(text.atof(F.col("t"))).collect()[4][0] == 150.0
    tags = spark.createDataFrame([("RG:Z:a:b",), ("NM:i:-3",)], "t string").select(text.tag(F.col("t")).alias("t")).select("t.*").collect()
    assert [tuple(r) for r in tags] == [("RG", "Z", "a:b"), ("NM", "i", "-3")]


def test_fastq(spark, tmp_path):
    records = [(f"RUN77.{i} MACH3:21:FLOWA:3:11:512:{i}/1", "ACGTN" * 3, "@@+II" * 3) for i in range(500)]
    (tmp_path / "a.fastq").write_text("".join(f"@{n}\n{b}\n+\n{q}\n" for n, b, q in records))
    (tmp_path / "b.fastq").write_text("@r\nA\n+\n@\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = fastq.scan(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = sorted((r for r in got if r["path"].endswith("a.fastq")), key=lambda r: r["record"])
    assert [(r["name"], r["BASES"], r["QUAL"]) for r in first] == records and len(got) == 501
    parts = spark.createDataFrame([(records[3][0],)], "n string").select(fastq.name_parts(F.col("n"))).first()[0]
    assert parts == ["RUN77", "3", "MACH3", "21", "FLOWA", "3", "11", "512", "3", "1"]


def test_sam(spark, tmp_path):
    rows = ["@HD\tVN:1.5", "SEQ-X9:31:FLOWB:1:7:64:905\t99\tchr2\t100\t60\t5M\t=\t-5\t-250\tACGTN\tIIIII\tNM:i:-3\tRG:Z:x:y\tRG:Z:last", "r2\t4\t*\t0\t0\t*\tchr2\t0\t0\tA\tI"]
    (tmp_path / "a.sam").write_text("\n".join(rows) + "\n")
    df = sam.with_reference_ids(sam.tag_columns(sam.scan(spark, str(tmp_path)), {"NM": "i", "RG": "Z"})).orderBy("line_no").collect()
    a, b = df
    assert (a["NAME-1"], a["NAME-2"], a["NAME-3"], a["NAME-7"], a["FLAG"], a["POS"], a["MAPQ"], a["PNEXT"], a["TLEN"]) == ("SEQ-X9", 31, "FLOWB", 905, 99, 100, 60, -5, -250)
    assert (a["NM"], a["RG"], a["BASES"]) == (-3, "last", "ACGTN") and b["NM"] is None and b["NAME-2"] is None
    assert [(r["RNAME_id"], r["RNEXT_id"]) for r in df] == [(0, 1), (2, 0)]


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\n20\t14370\trs1\tG\tA\t29.5\tPASS\tNS=3;DB;AF=0.5\tGT:GQ\t0|1:4\t.|0\n20\t17330\t.\tT\tA\t.\tq10\t.\tGT\t1/1\n")
    df = vcf.scan(spark, str(tmp_path)).orderBy("line_no").collect()
    assert (df[0]["POS"], df[0]["QUAL"], df[0]["INFO"]) == (14370, 29.5, {"NS": "3", "DB": "", "AF": "0.5"}) and df[1]["QUAL"] is None and df[1]["INFO"] == {}
    alleles = vcf.genotypes(vcf.scan(spark, str(tmp_path))).orderBy("line_no", "sample", "hap").collect()
    assert [(r["line_no"], r["sample"], r["hap"], r["allele"]) for r in alleles] == [(2, 0, 0, 0), (2, 0, 1, 1), (2, 1, 0, None), (2, 1, 1, 0), (3, 0, 0, 1), (3, 0, 1, 1)]


def test_tables_and_fasta(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# c\ntrack x\nchr1\t5\t9\tn\t1.5\t+\nchr2\t1\t2\n")
    got = [tuple(r) for r in lines.tabular(spark, str(tmp_path / "a.bed"), "bed").collect()]
    assert got == [("chr1", 5, 9, "n", 1.5, "+"), ("chr2", 1, 2, None, None, None)]
    (tmp_path / "a.fa").write_text(">one x\nACG\nT\n>two\n\n>three\nNN\n")
    fa = [(r["name"], r["seq"]) for r in lines.fasta(spark, str(tmp_path / "a.fa")).orderBy("record").collect()]
    assert fa == [("one x", "ACGT"), ("two", ""), ("three", "NN")]


@pytest.mark.parametrize("codec", ["ZSTD", "RC_QUAL", "RC_BASES", "RC_ILLUMINA_NAME"])
def test_codecs(spark, codec):
    rng = random.Random(codec)
    letters = "ACGTNacgtRYß" if codec == "RC_BASES" else "".join(map(chr, range(33, 100)))
    values = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(300)] + [None, "", "same", "same", None, "A"]
    df = spark.createDataFrame(list(enumerate(values)), "_ordinal long, v string").repartition(3)
    blocks = codecs.compress(df, "v", codec)
    back = codecs.decompress(blocks, "v").orderBy("_ordinal").collect()
    assert [r["v"] for r in back] == values
    with pytest.raises(Exception, match="checksum|differs"):
        codecs.decompress(blocks.withColumn("log", F.regexp_replace("log", '"md5": "..', '"md5": "zz')), "v").collect()


@pytest.mark.parametrize("values", [[], ["I"], ["IIII", "IIII", None], ["#" * 100_000, "~"]])
def test_codecs_small(values):
    raw = [None if v is None else v.encode() for v in values]
    for encode, decode in codecs.CODECS.values():
        assert decode(encode(raw)) == raw


def test_entropy_coder():
    import numpy as np
    from lodestrata.functions import entropy

    rng = np.random.default_rng(1)
    for n, kinds, mean in [(0, 4, 10), (1, 1, 1), (7, 3, 2), (5000, 41, 100), (70_000, 4, 150), (3000, 256, 10), (20_000, 1, 50)]:
        flat = np.clip(np.cumsum(rng.integers(-1, 2, n)) % kinds, 0, kinds - 1)
        starts = np.unique(rng.integers(0, max(1, n), max(1, n // mean)))
        data = entropy.encode(flat, starts, kinds)
        assert (entropy.decode(data, starts) == flat).all()
        if n >= 20_000:  # steps of -1, 0 and 1 hold log2(3) bits at most
            assert len(data) * 8 < 1.3 * n * (1.6 if kinds > 1 else 0.5)


def test_names_of_reads_shrink():
    values = [f"HX7:{8 + i // 4000}:{1000 + i * 7}:{i * 13 % 997}/1".encode() for i in range(4096)] + [None, b"", b"odd name", b"007:x"]
    data = codecs.encode_names(values)
    assert codecs.decode_names(data) == values and len(data) < 0.6 * len(codecs.encode_plain(values))


@pytest.mark.parametrize("split", [False, True])
def test_archive(spark, tmp_path, split):
    df = assign_batches(spark.createDataFrame([(i, i * 0.5 if i % 3 else None, [i] * (i % 3), f"k{i // 20}") for i in range(50)], "id long, v double, t array<int>, s string"), "id", 8)
    path = f"{tmp_path}/a"
    archive.write(df, path, dictionaries=("s",), blooms=("id",), transforms={"s": (), "v": ("ZSTD",), "t": ()}, split=split, part=2)
    key = lambda r: r["_ordinal"]
    assert sorted(archive.read(spark, path).select(df.columns).collect(), key=key) == sorted(df.collect(), key=key)
    assert archive.read(spark, path, ["v"]).columns == ["part", "batch_id", "_ordinal", "_schema_id", "v"]
    assert archive.table(spark, path, "batches").count() == 7
    stats = {(r["batch_id"], r["field"]): r for r in archive.table(spark, path, "column_stats").collect()}
    assert stats[0, "v"]["n_null"] == 3 and stats[0, "t"]["n_elements"] == 7 and (stats[1, "t"]["min_v"], stats[1, "t"]["max_v"]) == (8.0, 14.0)
    assert stats[0, "s"]["u_sz"] == 16 and stats[0, "id"]["u_sz"] is None
    for c in ("s", "v", "t"):
        assert sorted(map(tuple, archive.decoded(spark, path, c).collect())) == sorted(map(tuple, df.select("batch_id", "_ordinal", c).collect()), key=lambda r: r[:2])
    found = {r["field"]: r for r in archive.describe(spark, path).collect()}
    assert found["s"]["transforms"] == "AUTO" and found["v"]["n"] == 33 and found["id"]["fold"] == 0


def test_scans_read_the_folders_that_can_hold_rows(spark, tmp_path):
    df = assign_batches(spark.createDataFrame([(i, float(i), f"k{i // 20}", i * 7) for i in range(100)], "id long, v double, s string, u long"), "id", 10)
    path = f"{tmp_path}/a"
    archive.write(df, path, dictionaries=("s",), blooms=("u",), part=2)
    ids = lambda rows: sorted(r["id"] for r in rows.collect())
    left = lambda **tests: sorted(r["batch_id"] for r in archive.surviving(spark, path, **tests).collect())
    assert left(ranges={"v": (35, 31)}) == [3] and left(members={"s": "k2"}) == [4, 5] and left(ranges={"v": (35, 45)}, members={"s": "k2"}) == [4]
    assert 7 in left(hashed={"u": 77 * 7}) and len(left(hashed={"u": 77 * 7})) <= 3 and len(left(hashed={"u": -1})) <= 3
    assert left(ranges={"s": (0, 1)}) == left() == list(range(10)) and left(members={"v": 3.0}) == list(range(10))
    rows = archive.scan(spark, path, F.col("v").between(31, 35), ranges={"v": (31, 35)})
    assert ids(rows) == [31, 32, 33, 34, 35]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "= 1)]" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert ids(archive.scan(spark, path, ranges={"v": (1000, 2000)})) == []


def test_schemas_of_rows(spark, tmp_path):
    df = assign_batches(spark.createDataFrame([(i, float(i) if i in (3, 14) else None) for i in range(30)], "id long, v double"), "id", 10)
    pattern = F.when(F.col("v").isNotNull(), F.array(F.lit("id"), F.lit("v"))).otherwise(F.array(F.lit("id")))
    archive.write(df, f"{tmp_path}/a", pattern=pattern)
    assert [tuple(r) for r in archive.table(spark, f"{tmp_path}/a", "schemas").orderBy("schema_id").collect()] == [(["id"], 0, 28), (["id", "v"], 1, 2)]
    assert sorted(r["id"] for r in archive.scan(spark, f"{tmp_path}/a", having=("v",)).collect()) == [3, 14]
    assert sorted(r["batch_id"] for r in archive.surviving(spark, f"{tmp_path}/a", having=("v",)).collect()) == [0, 1]


def test_empty_archive(spark, tmp_path):
    df = assign_batches(spark.createDataFrame([], "id long, v double"), "id", 16)
    archive.write(df, f"{tmp_path}/a", dictionaries=("v",), blooms=("id",), transforms={"v": ()})
    assert archive.read(spark, f"{tmp_path}/a").count() == archive.table(spark, f"{tmp_path}/a", "batches").count() == 0
    assert archive.scan(spark, f"{tmp_path}/a", ranges={"v": (0, 1)}).count() == archive.describe(spark, f"{tmp_path}/a").count() == 0


def test_stream(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(100 * k + i, float(i)) for i in range(10)], "id long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("id long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        append.append_stream(stream, f"{tmp_path}/out", "id", ["v"], f"{tmp_path}/ckpt", size=4).awaitTermination()
    data, stats = append.read(spark, f"{tmp_path}/out")
    assert data.count() == 20 and stats.count() == 6


def test_archive_works_its_rows_out_once(spark, tmp_path):
    df = assign_batches(spark.createDataFrame([(i, i * 0.5, f"k{i % 3}") for i in range(60)], "id long, v double, s string"), "id", 8).localCheckpoint()
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    path = f"{tmp_path}/a"
    pattern = F.when(F.col("id") % 2 == 0, F.array(F.lit("id"), F.lit("v"))).otherwise(F.array(F.lit("s"), F.lit("id")))
    archive.write(df.mapInArrow(counted, df.schema), path, pattern=pattern, dictionaries=("s",), blooms=("id",), transforms={"s": (), "v": ("ZSTD",)})
    assert seen.value == 60
    assert sorted(os.listdir(path)) == ["batches", "blooms", "column_stats", "data", "dictionaries", "encoded", "fields", "schemas"]
    assert {(r["batch_id"], tuple(r["fields"])) for r in archive.table(spark, path, "batches").collect()} == {(b, ("id", "v", "s")) for b in range(8)}


def test_encoded_fields_come_back_side_by_side(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else i, None if i % 7 == 0 else f"é{i % 3}", [i] * (i % 3) if i % 4 else None, -0.0 if i % 2 else float("nan")) for i in range(50)]
    df = assign_batches(spark.createDataFrame(rows, "id long, n int, s string, t array<int>, d double"), "id", 8)
    path = f"{tmp_path}/a"
    archive.write(df, path, transforms={"s": ("RC_ILLUMINA_NAME",), "n": ("DELTA", "ZSTD"), "t": (), "d": ("ZSTD",)})
    back = archive.decoded(spark, path, "s", "n", "t", "d")
    assert "Join" not in back._jdf.queryExecution().executedPlan().toString()
    told = lambda r: (*r[:5], str(r[5]))
    assert sorted(map(told, back.collect())) == sorted(map(told, df.select("batch_id", "_ordinal", "s", "n", "t", "d").collect()), key=lambda r: r[:2])


def test_decode_all_joins_by_key(spark):
    schema = "batch_id int, _ordinal long, a long, b string"
    one = spark.createDataFrame([(0, i, i * 10, None) for i in (1, 2, 3)] + [(1, 9, 9, None)], schema)
    two = spark.createDataFrame([(0, i, None, f"x{i}") for i in (3, 2, 5)], schema)
    blocks = pipeline.encode(one, "a").unionByName(pipeline.encode(two, "b"))
    got = pipeline.decode_all(blocks, {"a": one.schema["a"].dataType, "b": two.schema["b"].dataType})
    assert sorted(map(tuple, got.collect())) == [(0, 2, 20, "x2"), (0, 3, 30, "x3")]


def test_blocks_of_values_are_bounded_in_bytes(spark):
    sizes = [codecs.BLOCK_BYTES // 3] * 7 + [0] * 5000 + [codecs.BLOCK_BYTES * 2, 1, 2, 0, 0]
    cuts = list(codecs._blocks(np.array(sizes)))
    assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(sizes)
    assert all(b - a == 1 or b - a <= codecs.BLOCK and sum(sizes[a:b]) <= codecs.BLOCK_BYTES for a, b in cuts)
    df = spark.createDataFrame([(i, None if i == 3 else "né" * (i * 20_000)) for i in range(12)], "doc_id long, v string").coalesce(1)
    blocks = codecs.compress(df, "v", "ZSTD", "doc_id")
    assert all(len(r["keys"]) == 1 or json.loads(r["log"])["u_sz"] <= codecs.BLOCK_BYTES for r in blocks.collect()) and blocks.count() > 3
    assert sorted(map(tuple, codecs.decompress(blocks, "v", "doc_id").collect())) == sorted(map(tuple, df.collect()))


def test_fastq_records_across_file_blocks(spark, tmp_path):
    text = "".join(f"@r{i} x\n{'ACGT' * (i % 5)}\n+\n{'I' * (4 * (i % 5))}\n" for i in range(300)) + "@cut\nAC"
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq").write_text("@only\nA\n+\nI\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = fastq.scan(spark, str(tmp_path))
        got = sorted((r["path"][-4:], *r[1:]) for r in found.collect())
        assert lines.lines_in_blocks(spark, str(tmp_path))[0].select("path", "first").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("a.fq", i, f"r{i} x", "ACGT" * (i % 5), "I" * (4 * (i % 5))) for i in range(300)] + [("a.fq", 300, "cut", "AC", None), ("b.fq", 0, "only", "A", "I")]
    own = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow" in line]
    assert own, "whole records are put together without a shuffle"
