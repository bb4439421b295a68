"""Fields, schemas and rows whose fields differ: what the first rows show decides a field's type and layout."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.batching import BATCH, first_seen
from lodestrata.operators.transforms import valid_order
from lodestrata.types import checked, logical

#: Tables of more fields are kept as one row for each value.
WIDE = 500
SPLIT, TENSOR = "COLUMN", "TENSOR"


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    ptype: str
    layout: str
    transforms: tuple[str, ...] = ()


class FieldDictionary:
    """Field names with dense ids in the order of first appearance."""

    def __init__(self) -> None:
        self.by_name: dict[str, Field] = {}

    def find(self, name: str) -> int:
        """The field's id, or -1."""
        return self.by_name[name].id if name in self.by_name else -1

    def find_or_add(self, name: str, ptype: str, layout: str, transforms: tuple[str, ...] = ()) -> int:
        """The field's id. Another type or layout than the first raises."""
        logical(ptype)
        known = self.by_name.get(name)
        if known is None:
            known = self.by_name[name] = Field(len(self.by_name), name, ptype, layout, transforms)
        elif (known.ptype, known.layout) != (ptype, layout):
            raise TypeError(f"{name} is {known.ptype} {known.layout} and can't be {ptype} {layout}")
        return known.id


@dataclass
class RecordBuilder:
    """One row under construction; every field is set once."""

    slots: dict[str, tuple[str, str, object]] = field(default_factory=dict)

    def _set(self, name: str, ptype: str, layout: str, value: object) -> RecordBuilder:
        if name in self.slots:
            raise ValueError(f"{name} is set twice")
        self.slots[name] = (ptype, layout, value)
        return self

    def add(self, name: str, ptype: str, *values: object) -> RecordBuilder:
        """A scalar, or several values that go to a column each."""
        kind = logical(ptype)
        return self._set(name, ptype, SPLIT, [checked(v, kind) for v in values])

    def add_array(self, name: str, ptype: str, values: list) -> RecordBuilder:
        """A tensor: an array that stays one value; it may be empty."""
        kind = logical(ptype)
        return self._set(name, ptype, TENSOR, [checked(v, kind) for v in values])


class TableBuilder:
    """Rows of any fields, kept in order, with their schemas; build() makes them a DataFrame.

    Rows are gathered in the driver: this is for tables made by hand. Large inputs come as DataFrames and
    go through null_padded_union() and schema_ids().
    """

    def __init__(self, batch_size: int = BATCH) -> None:
        self.batch_size, self.fields, self.patterns, self.rows = batch_size, FieldDictionary(), {}, []

    def set_field(self, name: str, ptype: str, layout: str = SPLIT, transforms: tuple[str, ...] = ()) -> None:
        """Declares a field before its first row; a known name stays as it is."""
        if not valid_order(list(transforms)):
            raise ValueError(f"{transforms} can't follow each other")
        if self.fields.find(name) < 0:
            self.fields.find_or_add(name, ptype, layout, tuple(transforms))

    def append(self, record: RecordBuilder) -> int:
        """Adds a row and returns its schema id: rows have one schema if they set the same fields in the same order."""
        pattern = tuple(self.fields.find_or_add(n, p, layout) for n, (p, layout, _) in record.slots.items())
        schema = self.patterns.setdefault(pattern, len(self.patterns))
        self.rows.append((len(self.rows), len(self.rows) // self.batch_size, schema, {n: v for n, (_, _, v) in record.slots.items()}))
        return schema

    def schemas(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, list(p)) for p, i in self.patterns.items()], "schema_id int, field_ids array<int>")

    def field_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.id, f.name, f.ptype, f.layout, list(f.transforms)) for f in self.fields.by_name.values()], "field_id int, name string, ptype string, layout string, transforms array<string>")

    def build(self, spark: SparkSession) -> DataFrame:
        """_ordinal, _batch_id, _schema_id and a column for each field: scalars as they are, wider split fields as name_0, name_1 ..., tensors as arrays."""
        if len(self.fields.by_name) > WIDE:
            raise ValueError(f"more than {WIDE} fields: use build_long()")
        width = {f.name: max([1, *(len(r[3][f.name]) for r in self.rows if f.name in r[3])]) for f in self.fields.by_name.values() if f.layout == SPLIT}
        columns = [T.StructField("_ordinal", T.LongType()), T.StructField("_batch_id", T.IntegerType()), T.StructField("_schema_id", T.IntegerType())]
        getters = []
        for f in self.fields.by_name.values():
            kind, meta = logical(f.ptype).spark, {"ptype": f.ptype, "layout": f.layout, "transforms": list(f.transforms)}
            if f.layout == TENSOR:
                columns.append(T.StructField(f.name, T.ArrayType(kind), metadata=meta))
                getters.append(lambda v, n=f.name: v.get(n))
            for i in range(width.get(f.name, 0)):
                columns.append(T.StructField(f.name if width[f.name] == 1 else f"{f.name}_{i}", kind, metadata=meta))
                getters.append(lambda v, n=f.name, i=i: v[n][i] if n in v and i < len(v[n]) else None)
        return spark.createDataFrame([(o, b, s, *[g(v) for g in getters]) for o, b, s, v in self.rows], T.StructType(columns))

    def build_long(self, spark: SparkSession) -> DataFrame:
        """_ordinal, _batch_id, _schema_id, field_id and the values as text: one row for each field that a row sets."""
        rows = [(o, b, s, self.fields.find(n), [None if x is None else str(x) for x in v]) for o, b, s, values in self.rows for n, v in values.items()]
        return spark.createDataFrame(rows, "_ordinal bigint, _batch_id int, _schema_id int, field_id int, value array<string>")


def field_ids(df: DataFrame, names: Column, order: str) -> DataFrame:
    """name, id: fields by first appearance, over rows that have an ordered array of field names; ties in a row go by position."""
    each = df.select(order, F.posexplode(names).alias("slot", "name"))
    return first_seen(each, ["name"], F.struct(order, "slot"), name="id").select("name", "id")


def schema_ids(df: DataFrame, pattern: Column, order: str, name: str = "pattern") -> DataFrame:
    """pattern, schema_id, n_rows: the ordered field sets by first appearance. Equality is that of the whole pattern, not of a hash."""
    return first_seen(df.withColumn(name, pattern), [name], order, name="schema_id").select(name, "schema_id", F.col("_n").alias("n_rows"))


def rows_with(df: DataFrame, schemas: DataFrame, wanted: str, pattern: str = "pattern") -> DataFrame:
    """The rows of df (with schema_id) whose schema has the field; schemas are few next to rows and Spark sends them if they are small."""
    return df.join(schemas.where(F.array_contains(pattern, wanted)).select("schema_id"), "schema_id", "left_semi")


def local_fields(batched: DataFrame, names: Column, order: str) -> DataFrame:
    """batch_id, field, local_id: each batch's own numbering of the fields that occur in it."""
    # A batch's rows are reduced to its field sets first: a minimum of numbers needs no sort, one of structs does.
    sets = batched.select("batch_id", F.col(order).alias("_at"), names.alias("_set")).groupBy("batch_id", "_set").agg(F.min("_at").alias(order))
    each = sets.select("batch_id", order, F.posexplode("_set").alias("slot", "field"))
    return first_seen(each, ["field"], F.struct(order, "slot"), ["batch_id"], "local_id").select("batch_id", "field", "local_id")


def local_id(local: DataFrame, batch: int, field: str) -> int:
    """The number of a field in a batch of local_fields(), or -1."""
    found = local.where((F.col("batch_id") == batch) & (F.col("field") == field)).first()
    return found["local_id"] if found else -1
