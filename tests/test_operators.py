import random

import pytest
from lodestrata.operators import arrays, batching, bloom, dictionary, pipeline, prune, schema, stats, transforms
from lodestrata.types import checked, logical
from pyspark.sql import functions as F


def batched(spark, values, kind="double", size=4):
    df = spark.createDataFrame(list(enumerate(values)), f"id long, v {kind}")
    return batching.assign_batches(df, "id", size)


def test_ordinals(spark):
    keys = random.Random(1).sample(range(10_000), 997)
    got = batching.with_ordinal(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5), "k").collect()
    assert [r["_ordinal"] for r in sorted(got, key=lambda r: r["k"])] == list(range(997))
    assert batching.with_ordinal(spark.createDataFrame([], "k long"), "k").count() == 0


@pytest.mark.parametrize(
    "kind, values, low, high, inside, outside",
    [
        ("tinyint", [-90, -7, 33, 2], -90, 33, [(-20, 5), (-120, -80), (30, 60), (-125, 99), (33, 40), (-95, -90), (5, -20)], [(34, 100), (-120, -91)]),
        ("long", [77, 5012, 81, 4000000], 77, 4000000, [], []),
        ("double", [3.25, 70.5, -6000.75, 12.0], -6000.75, 70.5, [(-100.5, 1.5), (99, -99999)], [(-99999, -7000), (70.75, 80.5)]),
        ("double", [-3.5, -2.5], -3.5, -2.5, [(-3, -3)], [(-2, 0)]),
        ("double", [float("nan"), 1.0], 1.0, 1.0, [(1, 1)], [(2, 3)]),
    ],
)
def test_segment_statistics(spark, kind, values, low, high, inside, outside):
    found = stats.segment_stats(batched(spark, values, kind), ["v"])
    r = found.first()
    assert (r["min_v"], r["max_v"], r["n_records"], r["n_null"]) == (low, high, len(values), 0)
    for (a, b), want in [(x, True) for x in inside] + [(x, False) for x in outside]:
        assert found.select(stats.overlaps(F.col("min_v"), F.col("max_v"), a, b, F.col("n_null"), F.col("n_records"))).first()[0] is want


def test_unknown_statistics_keep_a_batch(spark):
    only_null = stats.segment_stats(batched(spark, [None, None]), ["v"])
    only_nan = stats.segment_stats(batched(spark, [float("nan"), None]), ["v"])
    test = stats.overlaps(F.col("min_v"), F.col("max_v"), 0, 1, F.col("n_null"), F.col("n_records"))
    assert only_null.select(test).first()[0] is False
    assert only_nan.select(test).first()[0] is True


def test_pruning_changes_no_answer(spark):
    rng = random.Random(2)
    values = [rng.choice([None, float("nan"), rng.uniform(-50, 50), i / 10]) for i in range(400)] + [None] * 8 + [-1.0 - i for i in range(8)]
    rows = batched(spark, values).withColumn("w", F.pmod("id", F.lit(7))).cache()
    for _ in range(6):
        a, b = sorted(rng.uniform(-60, 60) for _ in range(2))
        exact = F.col("v").between(a, b)
        want = sorted(r["id"] for r in rows.where(exact).collect())
        assert sorted(r["id"] for r in prune.pruned_scan(rows, prune.surviving(rows, {"v": (a, b)}), exact).collect()) == want
    exact = (F.col("w") == 3) & F.col("v").between(0, 40)
    want = sorted(r["id"] for r in rows.where(exact).collect())
    assert sorted(r["id"] for r in prune.pruned_scan(rows, prune.surviving(rows, {"v": (0, 40)}, {"w": 3}, {"w": 3}), exact).collect()) == want


def test_dictionary(spark):
    rows = batched(spark, ["b", "a", None, "b", "c", "c", "a", "a"], "string")
    values = dictionary.dictionary(rows, "v", "_ordinal")
    assert sorted(tuple(r) for r in values.collect()) == [(0, 0, "b"), (0, 1, "a"), (1, 0, "c"), (1, 1, "a")]
    coded = dictionary.encode(rows, "v", "_ordinal")
    assert [r["code"] for r in coded.orderBy("id").collect()] == [0, 1, 0, 0, 0, 0, 1, 1]
    back = dictionary.decode(coded.select("id", "batch_id", "code", F.col("v").isNotNull().alias("ok")), values, "v", F.col("ok"))
    assert [r["v"] for r in back.orderBy("id").collect()] == ["b", "a", None, "b", "c", "c", "a", "a"]
    assert dictionary.get(values.where("batch_id = 1"), 1).first()["v"] == "a" and dictionary.get(values, 251).count() == 0


def test_tensor_dictionary(spark):
    arrays_ = [[7, 3, 9, 30], [3, 9, 11], [30, 55], [7, 3, 9, 30]]
    df = spark.createDataFrame(list(enumerate(arrays_)), "id long, v array<int>")
    values = dictionary.dictionary(df, "v", "id", None)
    assert [r["v"] for r in values.orderBy("code").collect()] == arrays_[:3]
    assert values.agg(F.sum(F.size("v"))).first()[0] == 9
    one = lambda test: [r[0] for r in df.orderBy("id").select(test).collect()]
    assert one(dictionary.equals_array(F.col("v"), [30, 55])) == [False, False, True, False]
    assert one(dictionary.equals_array(F.col("v"), [7, 3])) == [False] * 4
    assert one(dictionary.starts_with(F.col("v"), [7, 3])) == [True, False, False, True]
    assert one(dictionary.any_element(F.col("v"), 3)) == [1, 1, 0, 1]


@pytest.mark.parametrize("distinct, total, pays", [(1, 5, False), (1, 6, True), (2, 10, False), (10, 10, False)])
def test_a_dictionary_pays_below_a_fifth(spark, distinct, total, pays):
    rows = batched(spark, [f"v{i % distinct}" for i in range(total)], "string", 100)
    assert dictionary.decision(rows, ["v"]).first()["use_dict"] is pays


def test_bloom(spark):
    assert bloom.optimal_bits(1000, 0.05) == 8192 and bloom.optimal_bits(1, 0.5) == 256
    with pytest.raises(ValueError):
        bloom.optimal_bits(10, 1.5)
    names = [f"member {i}" for i in range(1000)]
    members = spark.createDataFrame([(n,) for n in names], "v string")
    others = spark.createDataFrame([(f"other {i}",) for i in range(4000)], "v string")
    bits = bloom.optimal_bits(1000, 0.05)
    sieve = bloom.build(members, "v", bits)
    assert bloom.probe(members, "v", sieve, bits).count() == 1000
    assert bloom.probe(others, "v", sieve, bits).count() < 0.08 * 4000
    assert bloom.semi_join(others.unionAll(members), "v", members, "v").count() == 1000


def test_bloom_by_batch(spark):
    rows = batched(spark, list(range(40)), "long")
    found = {r["batch_id"] for r in bloom.may_have(rows, "v", 13, 4096, ["batch_id"]).collect()}
    assert 3 in found and len(found) < 3


@pytest.mark.parametrize(
    "order, fine",
    [
        ([], True), (["ZSTD"], True), (["DICT", "ZSTD"], True), (["DICT", "ZSTD", "RC_BASES"], True), (["BASES_2BIT", "DELTA_DELTA", "DICT", "RC_QUAL"], True), (["AUTO"], True),
        (["DICT", "DICT"], False), (["ZSTD", "DICT"], False), (["DICT", "DELTA"], False), (["BASES_2BIT", "DELTA_DELTA", "DICT", "DICT", "RC_QUAL"], False), (["AUTO", "DICT", "RC_QUAL"], False),
    ],
)
def test_transform_order(order, fine):
    assert transforms.valid_order(order) is fine


def test_delta_and_prefix_sum(spark):
    values = [101 * (i + 1) for i in range(50)] + [0, 2**32 - 1, 5]
    rows = batched(spark, values, "long", 20)
    coded = rows.withColumn("d", transforms.delta("v", "_ordinal")).cache()
    assert {r["d"] for r in coded.where("id between 21 and 39").collect()} == {101}
    assert [r[0] for r in coded.withColumn("p", transforms.prefix_sum("d", "_ordinal")).orderBy("id").select("p").collect()] == values


@pytest.mark.parametrize("times", [1, 2])
def test_difference_over_ranges(spark, times):
    values = [random.Random(i).randrange(1000) for i in range(57)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    got = [r["d"] for r in transforms.difference(df, "v", "id", "d", times, ranges=10).orderBy("id").collect()]
    for _ in range(times):
        values = [v - (values[i - 1] if i else 0) for i, v in enumerate(values)]
    assert got == values


def test_packed_bases(spark):
    seqs = ["", "A", "ACGT", "acgtN", "ACGTNNACGTRYK", "GATTACA" * 9, "N"]
    df = transforms.pack_bases(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), "seq")
    back = transforms.unpack_bases(df, "back").orderBy("id").collect()
    assert [r["back"] for r in back] == seqs and len(back[5]["packed"]) == 16


def test_arrays(spark):
    df = spark.createDataFrame([(0, [1]), (1, [2, 3]), (2, None), (3, []), (4, [4, 5, 6])], "id long, v array<int>")
    split = arrays.split_columns(df, "v", "v").orderBy("id").collect()
    assert [tuple(r)[1:] for r in split] == [(1, None, None), (2, 3, None), (None,) * 3, (None,) * 3, (4, 5, 6)]
    spans = arrays.offsets(df, "id", F.when(F.col("v").isNotNull(), F.size("v")))
    assert [tuple(r) for r in spans.orderBy("id").collect()] == [(0, 0, 1), (1, 1, 3), (2, 3, 3), (3, 3, 3), (4, 3, 6)]
    flat = spark.createDataFrame([(i, i + 1) for i in range(6)], "pos long, v int")
    back = arrays.tensors(flat, spans, "id", "pos", "v").orderBy("id").collect()
    assert [r["v"] for r in back] == [[1], [2, 3], [], [], [4, 5, 6]]


def test_types():
    assert checked(255, logical("UINT8")) == 255 and logical("UINT64").spark.simpleString() == "decimal(20,0)"
    for value, kind in [(256, "UINT8"), (-1, "UINT32"), (2**63, "INT64"), ("x", "INT8"), (True, "INT8"), (1, "TEXT")]:
        with pytest.raises(ValueError):
            checked(value, logical(kind))
    for name in ("UNKNOWN", "BYTE_ARRAY"):
        with pytest.raises(ValueError):
            schema.RecordBuilder().add("f", name, 1)


def test_table_builder(spark):
    R, table = schema.RecordBuilder, schema.TableBuilder(batch_size=3)
    ids = [table.append(r) for r in (R().add("a", "FLOAT", 1.0).add("b", "UINT32", 2), R().add("b", "UINT32", 3).add("a", "FLOAT", 4.0), R().add("a", "FLOAT", 5.0), R().add_array("t", "INT8", [1, 2]), R().add_array("t", "INT8", []))]
    assert ids == [0, 1, 2, 3, 3]
    rows = table.build(spark).orderBy("_ordinal").collect()
    assert [(r["_batch_id"], r["a"], r["b"], r["t"]) for r in rows] == [(0, 1.0, 2, None), (0, 4.0, 3, None), (0, 5.0, None, None), (1, None, None, [1, 2]), (1, None, None, [])]
    assert [r["field_ids"] for r in table.schemas(spark).orderBy("schema_id").collect()] == [[0, 1], [1, 0], [0], [2]]
    with pytest.raises(TypeError):
        table.append(R().add("a", "UINT32", 1))
    with pytest.raises(TypeError):
        table.append(R().add_array("a", "FLOAT", [1.0]))
    with pytest.raises(ValueError):
        R().add("a", "FLOAT", 1.0).add("a", "FLOAT", 1.0)
    with pytest.raises(ValueError):
        table.set_field("z", "FLOAT", transforms=("ZSTD", "DICT"))


def test_split_fields_widen(spark):
    table = schema.TableBuilder()
    for values in ([1], [2, 3], [3]):
        table.append(schema.RecordBuilder().add("f", "UINT32", *values))
    assert [tuple(r)[3:] for r in table.build(spark).orderBy("_ordinal").collect()] == [(1, None), (2, 3), (3, None)]
    assert schema.TableBuilder().build(spark).count() == 0


def test_thousands_of_fields(spark):
    table = schema.TableBuilder()
    for i in range(5000):
        table.append(schema.RecordBuilder().add(f"FIELD{i}", "UINT32", i))
    long = table.build_long(spark)
    assert len(table.patterns) == len(table.fields.by_name) == 5000
    assert long.where("field_id = _ordinal and value[0] = cast(_ordinal as string)").count() == 5000
    with pytest.raises(ValueError):
        table.build(spark)


def test_union_of_different_columns(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "x int, y double"), spark.createDataFrame([(3, "z")], "x int, w string")
    assert [tuple(r) for r in batching.null_padded_union(a, b).orderBy("x").collect()] == [(1, 2.0, None), (3, None, "z")]
    with pytest.raises(TypeError, match="x is both int and string"):
        batching.null_padded_union(a, spark.createDataFrame([("s",)], "x string"))


def test_compression_fold(spark):
    df = spark.createDataFrame([("a", 0, 0, 100, 20), ("a", 0, 1, 50, 10), ("a", 1, 0, 60, 20), ("b", 0, 0, 0, 0)], "field string, batch_id int, column_no int, u_sz long, c_sz long")
    got = {r["field"]: (r["n_columns"], r["u_sz"], r["c_sz"], r["fold"]) for r in stats.compression_fold(df).collect()}
    assert got == {"a": (1.5, 210, 50, 4.2), "b": (1.0, 0, 0, 0.0)}


@pytest.mark.parametrize("partitions", ["1", "7", "300"])
def test_ordinals_with_any_number_of_ranges(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        keys = random.Random(3).sample(range(10**6), 500)
        got = batching.with_ordinal(spark.createDataFrame([(k,) for k in [*keys, None]], "k long"), "k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["_ordinal"] for r in sorted(got, key=lambda r: (r["k"] is not None, r["k"]))] == list(range(501))


TEXTS = [None, "", "ACGTNacgt", "AC", "longer text é", "AC", "AC", ""] * 20
PIPELINES = [
    (TEXTS, "string", [[], ["AUTO"], ["ZSTD"], ["DICT", "ZSTD"], ["RC_QUAL"], ["RC_BASES"], ["RC_ILLUMINA_NAME"], ["BASES_2BIT", "ZSTD"], ["BASES_2BIT", "DELTA_DELTA", "DICT", "RC_QUAL"], ["DELTA", "ZSTD", "ZSTD"], ["NONE"], ["DICT", "ZSTD", "RC_BASES"], ["DICT"]]),
    ([5, None, 7, 7, 5, 2**32 - 1, 0], "bigint", [[], ["DELTA"], ["DELTA", "ZSTD"], ["DELTA_DELTA", "DICT", "ZSTD"], ["DICT"], ["NONE"]]),
    ([[1, 2, 3], None, [], [1, 2, 3], [9]], "array<int>", [[], ["DICT", "ZSTD"], ["DELTA", "ZSTD"], ["DELTA_DELTA"]]),
    ([1.5, None, -2.25, 1e300, 1.5], "double", [[], ["DICT", "ZSTD"]]),
    ([None, None], "string", [[], ["DICT"], ["RC_BASES"]]),
]


@pytest.mark.parametrize("values, kind, specs", PIPELINES)
def test_pipelines_come_back(values, kind, specs):
    inner, tensor = (kind[6:-1], True) if kind.startswith("array") else (kind, False)
    for names in specs:
        c = pipeline.column(values, inner, tensor)
        data, log = pipeline.transform(c, names)
        back = pipeline.restore(data, log)
        assert back.rows() == c.rows() and (back.valid == c.valid).all(), names
        assert [e["transform"] for e in log][:1] == ["PLAIN"]
        worse = data[:-3] + bytes(3) if len(data) > 3 else data
        with pytest.raises(Exception, match="."):
            pipeline.restore(worse[: len(worse) // 2], log)


def test_pipeline_over_batches(spark):
    for values, kind, specs in PIPELINES:
        rows = batched(spark, values, kind, 50)
        for names in specs[:2]:
            coded = pipeline.encode(rows, "v", names)
            back = pipeline.decode(coded, "v", rows.schema["v"].dataType).orderBy("_ordinal").collect()
            assert [r["v"] for r in back] == values
    broken = coded.withColumn("log", F.transform("log", lambda e: e.withField("md5", F.lit("0"))))
    with pytest.raises(Exception, match="checksum"):
        pipeline.decode(broken, "v", rows.schema["v"].dataType).collect()


def test_wrong_transforms_raise():
    whole, text = pipeline.column([1, 2], "bigint", False), pipeline.column(["a"], "string", False)
    for c, names, error in [(whole, ["RC_QUAL"], TypeError), (whole, ["BASES_2BIT"], TypeError), (pipeline.column([-1], "bigint", False), ["DELTA"], TypeError), (pipeline.column([0.5], "double", False), ["DELTA"], TypeError), (text, ["ZSTD", "DICT"], ValueError), (text, ["LZ"], ValueError)]:
        with pytest.raises(error):
            pipeline.transform(c, names)


def test_automatic_choice():
    few, many = [f"v{i % 3}" for i in range(100)], [f"v{i}" for i in range(100)]
    assert pipeline.automatic(pipeline.column(few, "string", False)) == ["DICT", "ZSTD"] and pipeline.automatic(pipeline.column(many, "string", False)) == ["ZSTD"]
    for n, kind, tensor, pays in [(20, "int", False, False), (19, "int", False, True), (30, "int", True, False), (29, "int", True, True)]:
        values = [[i % n] if tensor else i % n for i in range(100)]
        assert (pipeline.automatic(pipeline.column(values, kind, tensor)) == ["DICT", "ZSTD"]) is pays


def test_local_fields_reduces_rows_to_field_sets(spark):
    rows = spark.createDataFrame([(0, 5, ["a", "b"]), (0, 6, ["c", "a"]), (0, 7, ["a", "b"]), (1, 8, ["c"]), (1, 9, None), (1, 10, [])], "batch_id int, id long, names array<string>")
    found = schema.local_fields(rows, F.col("names"), "id")
    assert sorted(map(tuple, found.collect())) == [(0, "a", 0), (0, "b", 1), (0, "c", 2), (1, "c", 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.rindex("Aggregate [")  # what is exploded has been reduced before
