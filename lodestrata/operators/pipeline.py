"""Transform pipelines: a batch of a column through a list of transforms, with a log, and back.

A column is its values with their validity; text is an array of bytes, an array keeps offsets into flat
values. Encoders change the values, compressors the bytes. Every step adds an entry to the log: what it
did, the bytes before and after, and the MD5 of those after. Decoding goes through the log backwards and
verifies each checksum. Batches are bounded, so a task works on one batch of one column at a time.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import codecs
from lodestrata.operators.dictionary import SCALAR_SHARE, TENSOR_SHARE
from lodestrata.operators.transforms import MODULUS, valid_order

#: Kinds of values, by Spark's type: how they lie in memory.
KINDS = {"tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8", "string": "|u1"}
LOG = "array<struct<transform:string,u_sz:bigint,c_sz:bigint,md5:string,args:string>>"


@dataclass
class Column:
    """Values of one batch: flat ones, and for arrays and text the offsets of each row."""

    valid: np.ndarray
    data: np.ndarray
    offsets: np.ndarray | None = None

    def bytes(self) -> bytes:
        return self.data.tobytes()

    def rows(self) -> list:
        if self.offsets is None:
            return self.data.tolist()
        flat = self.data.tobytes() if self.data.dtype == np.uint8 else self.data
        return [flat[a:b] if isinstance(flat, bytes) else tuple(flat[a:b].tolist()) for a, b in zip(self.offsets, self.offsets[1:], strict=False)]


def column(values: list, kind: str, tensor: bool) -> Column:
    """The values of a batch; null is 0 or an empty array, with its validity apart."""
    valid, dtype = np.array([v is not None for v in values], bool), np.dtype(KINDS[kind])
    if not tensor and kind != "string":
        return Column(valid, np.array([0 if v is None else v for v in values], dtype))
    own = [(v or "").encode("utf-8", "surrogatepass") if kind == "string" else list(v if v is not None else ()) for v in values]
    if any(x is None for v in own for x in (v if kind != "string" else ())):
        raise ValueError("arrays with nulls inside have no place in a column")
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in own])]).astype(np.int64)
    flat = np.frombuffer(b"".join(own), np.uint8) if kind == "string" else np.array([x for v in own for x in v], dtype)
    return Column(valid, flat, offsets)


def _from_arrow(values: pa.Array, kind: str, tensor: bool) -> Column:
    """What column() makes, from an Arrow array; text and numbers are taken over as they lie in memory."""
    if tensor:
        return column(values.to_pylist(), kind, tensor)
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    if kind != "string":
        return Column(valid, values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.dtype(KINDS[kind])))
    return Column(valid, *_text(values.cast(pa.large_binary()).fill_null(b"")))


def _text(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary array without nulls, and the offsets of its values."""
    _, offsets, flat = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(flat if flat is not None else b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _to_arrow(c: Column, kind: pa.DataType) -> pa.Array:
    """A column's values with their nulls, as an Arrow array."""
    rows = c.rows()
    if pa.types.is_list(kind):
        return pa.array([list(v) if ok else None for v, ok in zip(rows, c.valid.tolist(), strict=True)], kind)
    if c.offsets is None:
        return pa.array(c.data, kind, mask=~c.valid, from_pandas=False)
    return pa.array(rows, pa.binary(), mask=~c.valid).cast(kind)


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _dictionary(c: Column) -> tuple[list, np.ndarray]:
    """Distinct valid values by first appearance, and each row's code; a null has code 0."""
    if len(c.valid) and (c.data.dtype.kind in "iu" if c.offsets is None else c.data.dtype == np.uint8 and _whole(c)):
        own = pa.array(c.data if c.offsets is None else c.rows(), pa.from_numpy_dtype(c.data.dtype) if c.offsets is None else pa.large_binary(), mask=~c.valid)
        found = own.dictionary_encode()
        return found.dictionary.to_pylist(), found.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    seen: dict = {}
    rows = c.rows()
    codes = [seen.setdefault(v, len(seen)) if ok else 0 for v, ok in zip(rows, c.valid.tolist(), strict=True)]
    return list(seen), np.array(codes, np.int64)


def share(c: Column) -> float:
    """Distinct values among valid ones; 1 without any."""
    n = int(c.valid.sum())
    return len(_dictionary(c)[0]) / n if n else 1.0


def automatic(c: Column) -> list[str]:
    """What a column gets that names no transforms: a dictionary where it pays, and zstd."""
    limit = SCALAR_SHARE if c.offsets is None else TENSOR_SHARE
    return ["DICT", "ZSTD"] if share(c) < limit else ["ZSTD"]


def _whole(c: Column) -> bool:
    """Whether the offsets still are those of the flat values, which earlier transforms may have changed."""
    return c.offsets is not None and len(c.offsets) > 0 and int(c.offsets[-1]) == len(c.data) and bool((np.diff(c.offsets) >= 0).all())


def _step(c: Column, name: str, sections: dict[str, bytes], first: bool) -> tuple[Column | bytes, dict]:
    """One transform of a column that no compressor has changed: what it becomes, and what undoing it needs.

    sections: bytes that go beside. first: no other transform has changed the values. Where one has, values
    no longer are those of rows, so that dictionaries take every one, valid or not, and codecs all bytes as one.
    """
    if name == "NONE":
        return c.bytes(), {"dtype": c.data.dtype.str}
    if name == "ZSTD":
        return zstandard.compress(c.bytes(), codecs.LEVEL), {"dtype": c.data.dtype.str}
    if name in ("RC_QUAL", "RC_BASES", "RC_ILLUMINA_NAME"):
        if first and (c.offsets is None or c.data.dtype != np.uint8):
            raise TypeError(f"{name} is for text")
        return codecs.CODECS[name][0](c.rows() if first or _whole(c) and c.data.dtype == np.uint8 else [c.bytes()]), {"dtype": c.data.dtype.str}
    if name == "DICT":
        tensor = first and c.offsets is not None
        values, codes = _dictionary(c if first else Column(np.ones(len(c.data), bool), c.data))
        flat = b"".join(values) if c.data.dtype == np.uint8 and tensor else np.array([x for v in values for x in v] if tensor else values, c.data.dtype).tobytes()
        sizes = np.array([len(v) for v in values] if tensor else [], "<i8").tobytes()
        sections["dictionary"] = codecs._frames(sizes, flat)
        return Column(c.valid, codes, None if tensor else c.offsets), {"dtype": c.data.dtype.str, "tensor": tensor, "first": first}
    if name in ("DELTA", "DELTA_DELTA"):
        times = 1 if name == "DELTA" else 2
        whole = c.offsets if c.offsets is not None else c.data.astype(np.int64)
        if c.offsets is None and (c.data.dtype.kind != "i" or ((whole < 0) | (whole >= MODULUS)).any()):
            raise TypeError(f"{name} is for whole numbers from 0 to 2^32 - 1, and for the offsets of arrays")
        for _ in range(times):
            whole = _delta(whole) % MODULUS
        if c.offsets is not None:
            return Column(c.valid, c.data, whole), {"dtype": c.data.dtype.str, "tensor": True}
        return Column(c.valid, whole.astype("<i8")), {"dtype": c.data.dtype.str, "tensor": False}
    if name == "BASES_2BIT":
        if c.offsets is None or c.data.dtype != np.uint8:
            raise TypeError("BASES_2BIT is for text")
        codes = codecs._CODES[c.data]
        odd = np.flatnonzero(codes == 255)
        sections["odd"] = codecs._frames(odd.astype("<i8").tobytes(), c.data[odd].tobytes())
        four = np.append(np.where(codes == 255, 0, codes), np.zeros(-len(codes) % 4, np.uint8)).reshape(-1, 4).astype(np.uint8)
        return Column(c.valid, (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8), c.offsets), {"dtype": "|u1", "n": len(codes)}
    raise ValueError(f"unknown transform {name}")


def _undo(data: Column | bytes, name: str, args: dict, c: Column, sections: dict[str, bytes]) -> Column:
    """The column before a transform. c has the validity, and the offsets as they were after it."""
    dtype = np.dtype(args["dtype"])
    if name in ("NONE", "ZSTD"):
        return Column(c.valid, np.frombuffer(data if name == "NONE" else zstandard.decompress(data), dtype), c.offsets)
    if name in codecs.CODECS:
        return Column(c.valid, np.frombuffer(b"".join(v or b"" for v in codecs.CODECS[name][1](data)), dtype), c.offsets)
    if name == "DICT":
        sizes, flat = codecs._unframe(sections["dictionary"])
        values, codes = np.frombuffer(flat, dtype), data.data
        if not args["tensor"]:
            found = values[codes] if len(values) else np.zeros(len(codes), dtype)
            return Column(c.valid, np.where(c.valid, found, dtype.type(0)) if args["first"] else found, data.offsets)
        ends = np.cumsum(np.frombuffer(sizes, "<i8"))
        starts = ends - np.frombuffer(sizes, "<i8")
        parts = [values[starts[k] : ends[k]] if ok else values[:0] for k, ok in zip(codes.tolist(), c.valid.tolist(), strict=True)]
        return Column(c.valid, np.concatenate([*parts, values[:0]]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
    if name in ("DELTA", "DELTA_DELTA"):
        whole = data.offsets if args["tensor"] else data.data
        for _ in range(1 if name == "DELTA" else 2):
            whole = np.cumsum(whole) % MODULUS
        return Column(c.valid, data.data, whole) if args["tensor"] else Column(c.valid, whole.astype(dtype))
    if name == "BASES_2BIT":
        p = data.data
        flat = np.frombuffer(b"ACGT", np.uint8)[np.stack([p & 3, p >> 2 & 3, p >> 4 & 3, p >> 6], axis=1).ravel()][: args["n"]].copy()
        at, odd = codecs._unframe(sections["odd"])
        flat[np.frombuffer(at, "<i8")] = np.frombuffer(odd, np.uint8)
        return Column(c.valid, flat, data.offsets)
    raise ValueError(f"unknown transform {name}")


def transform(c: Column, names: list[str]) -> tuple[bytes, list[dict]]:
    """A column's bytes after the transforms, and the log. Without names, or with AUTO, automatic() chooses; offsets that none changes are differenced."""
    if not valid_order(names):
        raise ValueError(f"{names} can't follow each other")
    plain = c.bytes()
    log = [{"transform": "PLAIN", "u_sz": len(plain), "c_sz": len(plain), "md5": hashlib.md5(plain).hexdigest(), "args": "{}"}]
    names = automatic(c) if not names or names == ["AUTO"] else list(names)
    if c.offsets is not None and not {"DICT", "DELTA", "DELTA_DELTA", "RC_QUAL", "RC_BASES", "RC_ILLUMINA_NAME"} & set(names):
        names = ["DELTA", *names]
    sections, now = {}, c
    for name in names:
        before = now if isinstance(now, bytes) else now.bytes()
        if isinstance(now, bytes):  # a second compressor sees the bytes of the first
            now = Column(c.valid, np.frombuffer(now, np.uint8), None if name == "ZSTD" or name == "NONE" else np.array([0, len(now)]))
            rows = Column(np.ones(1, bool), now.data, now.offsets)
            now, args = _step(rows, name, sections, False)
        else:
            shape = now
            now, args = _step(now, name, sections, len(log) == 1)
            if isinstance(now, bytes):
                c = shape
        after = now if isinstance(now, bytes) else now.bytes()
        log.append({"transform": name, "u_sz": len(before), "c_sz": len(after), "md5": hashlib.md5(after).hexdigest(), "args": json.dumps(args)})
    last = now if isinstance(now, Column) else c
    offsets = b"" if last.offsets is None else b"o" + zstandard.compress(last.offsets.astype("<i8").tobytes())
    head = json.dumps({"n": len(c.valid), "dtype": last.data.dtype.str, "sections": list(sections)}).encode()
    body = now if isinstance(now, bytes) else now.bytes()
    return codecs._frames(head, zstandard.compress(np.packbits(c.valid).tobytes()), offsets, body, *(zstandard.compress(x) for x in sections.values())), log


def restore(data: bytes, log: list[dict]) -> Column:
    """The column back. Raises where bytes differ from their checksum, or the log names an unknown transform."""
    head, valid, offsets, body, *rest = codecs._unframe(data)
    told = json.loads(head)
    sections = dict(zip(told["sections"], map(zstandard.decompress, rest), strict=True))
    ok = np.unpackbits(np.frombuffer(zstandard.decompress(valid), np.uint8))[: told["n"]].astype(bool)
    shape = Column(ok, np.zeros(0, told["dtype"]), np.frombuffer(zstandard.decompress(offsets[1:]), "<i8") if offsets else None)
    squeezed = [e["transform"] in (*codecs.CODECS, "NONE") for e in log]
    now: Column | bytes = body if any(squeezed) else Column(ok, np.frombuffer(body, told["dtype"]), shape.offsets)
    for k in range(len(log) - 1, -1, -1):
        found = now if isinstance(now, bytes) else now.bytes()
        if hashlib.md5(found).hexdigest() != log[k]["md5"]:
            raise ValueError(f"the bytes after {log[k]['transform']} differ from their checksum")
        if k:
            args = json.loads(log[k]["args"])
            inner = squeezed[k] and squeezed[k - 1]
            now = _undo(now, log[k]["transform"], args, shape, sections)
            now = now.bytes() if inner else now
    return now


def _kind(df: DataFrame, field: str) -> tuple[str, bool]:
    """Kind of the values and whether they are arrays that stay one value. Text is an array of bytes."""
    t = df.schema[field].dataType
    inner = t.elementType if isinstance(t, T.ArrayType) else t
    if inner.simpleString() not in KINDS or isinstance(t, T.ArrayType) and isinstance(inner, T.StringType):
        raise TypeError(f"no transforms for {t.simpleString()}")
    return inner.simpleString(), isinstance(t, T.ArrayType)


def encode(batched: DataFrame, field: str, names: list[str] | tuple[str, ...] = (), order: str = "_ordinal") -> DataFrame:
    """batch_id, field, n_rec, keys, data and log: a row for each batch of the column. keys: the order's values, by which rows come back."""
    return encode_all(batched, {field: names}, order)


def encode_all(batched: DataFrame, transforms: dict[str, list[str] | tuple[str, ...]], order: str = "_ordinal") -> DataFrame:
    """encode() for several columns, each with its transforms; the rows of a batch meet once for all of them."""
    steps = []
    for field, names in transforms.items():
        if not valid_order(list(names)):
            raise ValueError(f"{list(names)} can't follow each other")
        steps.append((field, *_kind(batched, field), list(names)))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("k")
        keys, rows = part.column("k").combine_chunks(), []
        for i, (field, kind, tensor, names) in enumerate(steps):
            values = part.column(f"v{i}").combine_chunks()
            data, log = transform(_from_arrow(values, kind, tensor), names)
            rows.append({"field": field, "data": data, "log": log})
        n = len(rows)
        every = {"batch_id": [part.column("batch_id")[0].as_py()] * n, "field": [r["field"] for r in rows], "n_rec": [len(keys)] * n}
        held = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(keys), pa.int32()), pa.concat_arrays([keys] * n))
        kinds = [pa.int32(), pa.string(), pa.int64()]
        entry = pa.list_(pa.struct([("transform", pa.string()), ("u_sz", pa.int64()), ("c_sz", pa.int64()), ("md5", pa.string()), ("args", pa.string())]))
        own = [pa.array(v, t) for v, t in zip(every.values(), kinds, strict=True)]
        return pa.Table.from_arrays([*own, held, pa.array([r["data"] for r in rows], pa.binary()), pa.array([r["log"] for r in rows], entry)], ["batch_id", "field", "n_rec", "keys", "data", "log"])

    rows = batched.select(F.col("batch_id").cast("int").alias("batch_id"), F.col(order).cast("long").alias("k"), *[F.col(f).alias(f"v{i}") for i, f in enumerate(transforms)])
    return rows.groupBy("batch_id").applyInArrow(run, f"batch_id int, field string, n_rec bigint, keys array<bigint>, data binary, log {LOG}")


def _restored(row: pa.RecordBatch | pa.Table, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """The keys and the values of one of encode()'s rows."""
    one = row.select(["data", "log"]).to_pylist()[0]
    return row["keys"][0].values, _to_arrow(restore(one["data"], one["log"]), kind)


def decode(blocks: DataFrame, field: str, kind: T.DataType, order: str = "_ordinal") -> DataFrame:
    """batch_id, order and field of encode()'s rows; kind is the field's Spark type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, values = _restored(batch.slice(i, 1), schema.field(2).type)
                yield pa.RecordBatch.from_arrays([pa.array([batch["batch_id"][i].as_py()] * len(keys), pa.int32()), keys.cast(pa.int64()), values], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("batch_id", pa.int32()), (order, pa.int64()), (field, to_arrow_type(kind))])
    return blocks.select("batch_id", "keys", "data", "log").mapInArrow(run, T.StructType([T.StructField("batch_id", T.IntegerType()), T.StructField(order, T.LongType()), T.StructField(field, kind)]))


def decode_all(blocks: DataFrame, kinds: dict[str, T.DataType], order: str = "_ordinal") -> DataFrame:
    """batch_id, order and several fields of encode_all()'s rows, side by side where all of them have the order's value. The encoded batches meet, not their rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("batch_id", pa.int32()), (order, pa.int64()), *((f, to_arrow_type(t)) for f, t in kinds.items())])

    def run(part: pa.Table) -> pa.Table:
        at = {f: i for i, f in enumerate(part.column("field").to_pylist())}
        if not all(f in at for f in kinds):
            return schema.empty_table()
        found = [_restored(part.slice(at[f], 1), schema.field(f).type) for f in kinds]
        keys = [k.to_numpy() for k, _ in found]
        values = [v for _, v in found]
        if any(not np.array_equal(keys[0], k) for k in keys[1:]):
            both = keys[0]
            for k in keys[1:]:
                both = np.intersect1d(both, k)
            values = [v.take(pa.array(np.argsort(k, kind="stable")[np.searchsorted(np.sort(k), both)])) for k, v in zip(keys, values, strict=True)]
            keys[0] = both
        own = [pa.array(np.full(len(keys[0]), part.column("batch_id")[0].as_py(), np.int32)), pa.array(keys[0], pa.int64())]
        return pa.Table.from_arrays([*own, *values], schema=schema)

    told = T.StructType([T.StructField("batch_id", T.IntegerType()), T.StructField(order, T.LongType()), *(T.StructField(f, t) for f, t in kinds.items())])
    return blocks.where(F.col("field").isin(list(kinds))).select("batch_id", "field", "keys", "data", "log").groupBy("batch_id").applyInArrow(run, told)


def log_table(blocks: DataFrame) -> DataFrame:
    """batch_id, field, step, transform, u_sz, c_sz, md5: the logs, an entry a row."""
    return blocks.select("batch_id", "field", F.posexplode("log").alias("step", "e")).select("batch_id", "field", "step", "e.transform", "e.u_sz", "e.c_sz", "e.md5")
