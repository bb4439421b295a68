"""Lossless codecs for columns of text, a batch of rows at a time, with a log of sizes and checksums.

The quality codec and the base codec code symbols by the ones before them (entropy.py), the latter with
exceptions beside the four bases; the name codec cuts names at punctuation and writes each part's column by
itself. Values come back exactly, whatever characters they hold.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from lodestrata.functions import entropy

LEVEL = 9
#: Values in a block, and the bytes after which it ends: what one call of a codec sees. A longer value has a block of its own.
BLOCK, BLOCK_BYTES = 4096, 1 << 20
_CODES = np.full(256, 255, np.uint8)
_CODES[[65, 67, 71, 84]] = [0, 1, 2, 3]


def _lengths(values: list[bytes | None]) -> bytes:
    return np.array([-1 if v is None else len(v) for v in values], "<i8").tobytes()


def _cut(flat: bytes, lengths: np.ndarray) -> list[bytes | None]:
    out, at = [], 0
    for n in lengths.tolist():
        out.append(None if n < 0 else flat[at : at + n])
        at += max(n, 0)
    return out


def _frames(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<Q", len(p)) + p for p in parts)


def _unframe(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = struct.unpack_from("<Q", data, at)[0]
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def encode_plain(values: list[bytes | None]) -> bytes:
    return zstandard.compress(_frames(_lengths(values), b"".join(v or b"" for v in values)), LEVEL)


def decode_plain(data: bytes) -> list[bytes | None]:
    lengths, flat = _unframe(zstandard.decompress(data))
    return _cut(flat, np.frombuffer(lengths, "<i8"))


def _starts(sizes: np.ndarray) -> np.ndarray:
    own = np.maximum(sizes, 0)
    return np.unique(np.cumsum(own) - own)


def encode_quality(values: list[bytes | None]) -> bytes:
    """Symbols by their place among those that occur, under the ones before them. A value equal to the one before it is only marked."""
    same = np.array([i > 0 and v is not None and v == values[i - 1] for i, v in enumerate(values)], bool)
    own = [b"" if v is None or s else v for v, s in zip(values, same, strict=True)]
    symbols, coded = np.unique(np.frombuffer(b"".join(own), np.uint8), return_inverse=True)
    stream = entropy.encode(coded, _starts(np.array([len(v) for v in own], np.int64)), max(1, len(symbols)))
    return _frames(zstandard.compress(_frames(_lengths(values), np.packbits(same).tobytes()), LEVEL), symbols.tobytes(), stream)


def decode_quality(data: bytes) -> list[bytes | None]:
    head, symbols, stream = _unframe(data)
    lengths, same = _unframe(zstandard.decompress(head))
    sizes = np.frombuffer(lengths, "<i8")
    marks = np.unpackbits(np.frombuffer(same, np.uint8))[: len(sizes)].astype(bool)
    own = np.where(marks, 0, sizes)
    coded = entropy.decode(stream, _starts(own))
    found = _cut(np.frombuffer(symbols, np.uint8)[coded].tobytes() if len(coded) else b"", own)
    for i in np.flatnonzero(marks):
        found[i] = found[i - 1]
    return found


def encode_bases(values: list[bytes | None]) -> bytes:
    """A, C, G and T as four symbols; every other character, lower case too, by place and as it was."""
    flat = np.frombuffer(b"".join(v or b"" for v in values), np.uint8)
    codes = _CODES[flat]
    odd = np.flatnonzero(codes == 255)
    stream = entropy.encode(np.where(codes == 255, 0, codes), _starts(np.array([len(v or b"") for v in values], np.int64)), 4)
    return _frames(zstandard.compress(_frames(_lengths(values), np.diff(odd, prepend=0).astype("<i8").tobytes(), flat[odd].tobytes()), LEVEL), stream)


def decode_bases(data: bytes) -> list[bytes | None]:
    head, stream = _unframe(data)
    lengths, steps, odd = _unframe(zstandard.decompress(head))
    sizes = np.frombuffer(lengths, "<i8")
    flat = np.frombuffer(b"ACGT", np.uint8)[entropy.decode(stream, _starts(sizes))].copy()
    flat[np.cumsum(np.frombuffer(steps, "<i8"))] = np.frombuffer(odd, np.uint8)
    return _cut(flat.tobytes(), sizes)


_PARTS = re.compile(rb"[0-9]+|[^0-9]+")


def encode_names(values: list[bytes | None]) -> bytes:
    """Names in parts of digits and of other characters. Parts in the same place are written together: numbers less the one before, others as they are."""
    sizes = np.array([len(v or b"") for v in values], np.int64)
    flat = np.frombuffer(b"".join(v or b"" for v in values), np.uint8)
    digit = (flat >= 48) & (flat <= 57)
    begins = np.diff(digit, prepend=~digit[:1])
    begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    at = np.flatnonzero(begins)
    lengths = np.diff(at, append=len(flat))
    counts = np.bincount(np.searchsorted(np.cumsum(sizes), at, side="right"), minlength=len(sizes))
    places = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    grouped = np.argsort(places, kind="stable")
    columns: list[bytes] = []
    for own in np.split(grouped, np.cumsum(np.bincount(places))[:-1]) if len(at) else []:
        first, n = at[own], lengths[own]
        if (digit[first] & (n <= 18) & ((flat[first] != 48) | (n == 1))).all():
            whole = np.zeros(len(own), np.int64)
            for j in range(int(n.max())):
                more = np.flatnonzero(n > j)
                whole[more] = whole[more] * 10 + (flat[first[more] + j].astype(np.int64) - 48)
            columns.append(b"n" + np.diff(whole, prepend=0).astype("<i8").tobytes())
        else:
            places_in = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            columns.append(b"t" + _frames(n.astype("<i8").tobytes(), flat[places_in].tobytes()))
    told = np.where([v is None for v in values], -1, counts) if len(values) else counts
    return _frames(*(zstandard.compress(c, LEVEL) for c in [told.astype("<i4").tobytes(), *columns]))


def decode_names(data: bytes) -> list[bytes | None]:
    counts, *columns = map(zstandard.decompress, _unframe(data))
    sizes = np.frombuffer(counts, "<i4")
    out: list[list[bytes]] = [[] for _ in sizes]
    for k, column in enumerate(columns):
        at = np.flatnonzero(sizes > k).tolist()
        if column[:1] == b"n":
            own = [b"%d" % x for x in np.cumsum(np.frombuffer(column[1:], "<i8")).tolist()]
        else:
            lengths, flat = _unframe(column[1:])
            own = _cut(flat, np.frombuffer(lengths, "<i8"))
        for i, x in zip(at, own, strict=True):
            out[i].append(x)
    return [None if n < 0 else b"".join(p) for n, p in zip(sizes.tolist(), out, strict=True)]


CODECS = {"ZSTD": (encode_plain, decode_plain), "RC_QUAL": (encode_quality, decode_quality), "RC_BASES": (encode_bases, decode_bases), "RC_ILLUMINA_NAME": (encode_names, decode_names)}


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """From where to where the blocks of values of these sizes go."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        end = min(at + BLOCK, max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right"))))
        yield at, end
        at = end


def compress(batched: DataFrame, field: str, codec: str, key: str = "_ordinal") -> DataFrame:
    """keys, data and log (codec, sizes, MD5 before and after) for blocks of rows of a text column; a block is what one task reads in a row, bounded in values and in bytes."""
    encode = CODECS[codec][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
            for at, end in _blocks(pc.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False)):
                part = batch.slice(at, end - at)
                values = [None if v is None else v.encode("utf-8", "surrogatepass") for v in part.column(1).to_pylist()]
                data, plain = encode(values), b"".join(v or b"" for v in values)
                log = json.dumps({"codec": codec, "u_sz": len(plain), "c_sz": len(data), "md5": hashlib.md5(plain).hexdigest(), "c_md5": hashlib.md5(data).hexdigest()})
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([log])], ["keys", "data", "log"])

    return batched.select(key, field).mapInArrow(run, "keys array<bigint>, data binary, log string")


def decompress(blocks: DataFrame, field: str, key: str = "_ordinal") -> DataFrame:
    """key and field of compressed blocks. Raises if a block's bytes don't have the MD5 in its log, or its codec is unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time, as a task's blocks may come in one batch
                keys, data, log = (batch.column(c)[i].as_py() for c in range(3))
                told = json.loads(log)
                if hashlib.md5(data).hexdigest() != told["c_md5"]:
                    raise ValueError("a block's stored bytes differ from their checksum")
                values = CODECS[told["codec"]][1](data)
                if hashlib.md5(b"".join(v or b"" for v in values)).hexdigest() != told["md5"]:
                    raise ValueError("a block differs from its checksum")
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([None if v is None else v.decode("utf-8", "surrogatepass") for v in values], pa.string())], [key, field])

    return blocks.mapInArrow(run, f"`{key}` bigint, `{field}` string")
