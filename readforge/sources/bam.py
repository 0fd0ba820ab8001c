"""BAM: alignment records in BGZF blocks, read and written by Spark's Python data source interface.

`spark.read.format("bam").load(path)` after `register(spark)` reads a file or a folder of files: BGZF, gzip or plain, and an
empty file as no records.  A BGZF file is read in stretches of `split` bytes: a task finds the first block of a stretch and
the first record in it by the chain of records that follows, and reads the records that begin in the stretch; many small
stretches share a task.  Filters on
`ref_id` and `pos` make it read only what an index beside the file (`.bai`) names.
`df.write.format("bam").option("header", text).save(path)` writes one file for each partition; files appear when the job
is committed, and those of lost tasks never do.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: The letters of base codes and CIGAR operations in the order of their numbers; sizes and formats of tags.
CODES, OPERATIONS = "-ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
MAGIC, MOST_BYTES = b"BAM\x01", 65_450
SCHEMA = "qname string, flag int, ref_id bigint, pos int, mapq int, cigar string, mate_ref_id bigint, mate_pos int, isize int, seq string, qual array<int>, tags array<struct<key:string,typ:string,value:string>>, virt_offset bigint"
_HEX = [CODES[i >> 4] + CODES[i & 15] for i in range(256)]
#: Bytes of a file that a task reads, records that must follow the guessed start of one, records in a batch.
SPLIT, FOLLOWING, BATCH = 64 << 20, 8, 4096
#: Stretches share tasks when there are more of them, but no task takes more than SPLIT bytes for that.
TASKS = 128
_SIZE = struct.Struct("<I").unpack_from
#: The fixed part of a record.
_FIXED = np.dtype([("ref_id", "<u4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("mate_ref_id", "<u4"), ("mate_pos", "<i4"), ("isize", "<i4")])


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let filters reach it."""
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- blocks


def block(data: bytes, level: int = 6) -> bytes:
    """One BGZF block; of no bytes, the mark of the end."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def is_bgzf(head: bytes) -> bool:
    return head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == b"BC\x02\0"


def kind_of(head: bytes) -> str:
    """What a file is by its first bytes: empty, bgzf, gzip, plain (BAM without compression) or sam (anything else)."""
    if not head:
        return "empty"
    if is_bgzf(head):
        return "bgzf"
    return "gzip" if head[:2] == b"\x1f\x8b" else "plain" if head[:4] == MAGIC else "sam"


def blocks(f, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, bytes) of each block from the place on, at which f stands; a cut or damaged block is an error."""
    while head := f.read(12):
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block begins at offset {at}")
        extra = f.read(struct.unpack("<H", head[10:12])[0])
        size, i = None, 0
        while i + 4 <= len(extra):
            n = struct.unpack("<H", extra[i + 2 : i + 4])[0]
            if extra[i : i + 2] == b"BC" and n == 2:
                size = struct.unpack("<H", extra[i + 4 : i + 6])[0] + 1
            i += 4 + n
        if size is None:
            raise ValueError(f"the block at offset {at} does not tell its size")
        rest = f.read(size - 12 - len(extra))
        if len(rest) != size - 12 - len(extra):
            raise ValueError(f"the file ends inside the block at offset {at}")
        data = zlib.decompress(rest[:-8], -15)
        if struct.unpack("<II", rest[-8:]) != (zlib.crc32(data), len(data)):
            raise ValueError(f"the block at offset {at} is damaged")
        yield at, data
        at += size


class _Near:
    """Blocks of a file from any place on; the last ones stay inflated, as they are asked for again where stretches meet."""

    def __init__(self, f, most: int = 8):
        self.f, self.most, self.held = f, most, {}

    def __call__(self, at: int) -> Iterator[tuple[int, bytes]]:
        while True:
            if at not in self.held:
                self.f.seek(at)
                if (one := next(blocks(self.f, at), None)) is None:
                    return
                if len(self.held) >= self.most:
                    self.held.pop(next(iter(self.held)))
                self.held[at] = one[1], self.f.tell()
            data, after = self.held[at]
            yield at, data
            at = after


def find_block(near: _Near, start: int, end: int) -> int | None:
    """The first place in [start, end) where a block begins whose checksum fits and that another block or the end follows."""
    f = near.f
    at = start
    while at < end:
        f.seek(at)
        window = f.read(1 << 17)
        i = window.find(b"\x1f\x8b\x08\x04")
        while i >= 0 and at + i < end:
            try:
                list(islice(near(at + i), 2))
                return at + i
            except (ValueError, struct.error, zlib.error):
                i = window.find(b"\x1f\x8b\x08\x04", i + 1)
        if len(window) < 1 << 17:
            return None
        at += len(window) - 3
    return None


def _inflated(f) -> Iterator[tuple[int, bytes]]:
    """Members of a gzip file, one after the other."""
    z, begun = zlib.decompressobj(31), False
    while chunk := f.read(1 << 20):
        while chunk:
            begun = True
            yield 0, z.decompress(chunk)
            chunk = z.unused_data
            if z.eof:
                z, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the file ends inside a gzip member")


def _plain(f) -> Iterator[tuple[int, bytes]]:
    at = 0
    while chunk := f.read(65_536):
        yield at, chunk
        at += len(chunk)


class Stream:
    """Bytes of successive blocks, with virtual offsets: the block's place in the file times 65536, plus the place in it."""

    def __init__(self, parts: Iterator[tuple[int, bytes]], skip: int = 0):
        self.parts, self.data, self.at, self.base = parts, b"", 0, 0
        if skip and self._more():
            self.at = skip

    def _more(self) -> bool:
        for base, data in self.parts:
            if data:
                self.base, self.data, self.at = base, data, 0
                return True
        return False

    def offset(self) -> int | None:
        """Virtual offset of the next byte; None at the end."""
        if self.at == len(self.data) and not self._more():
            return None
        return self.base << 16 | self.at

    def take(self, n: int) -> bytes:
        out = []
        while n:
            if self.at == len(self.data) and not self._more():
                raise ValueError("the stream ends inside a record")
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out.append(part)
        return b"".join(out)

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


# --- header


def parse_header(text: str) -> dict:
    """version, sorting, refs [(name, length, other fields)], other [(code, fields)] and comments of a header text."""
    out = {"version": (1, 0), "sorting": "unknown", "refs": [], "other": [], "comments": []}
    for line in text.splitlines():
        if line.startswith("@CO"):
            out["comments"].append(line[4:])
            continue
        code, *fields = line.split("\t")
        fields = [(x[:2], x[3:]) for x in fields if x[2:3] == ":"]
        named = dict(fields)
        if code == "@HD":
            out["version"] = tuple(int(x) for x in named.get("VN", "1.0").split("."))
            out["sorting"] = named.get("SO", "unknown")
        elif code == "@SQ" and "SN" in named and named.get("LN", "").isdigit():
            out["refs"].append((named["SN"], int(named["LN"]), [x for x in fields if x[0] not in ("SN", "LN")]))
        elif code.startswith("@"):
            out["other"].append((code[1:], fields))
    return out


def show_header(meta: dict) -> str:
    joined = lambda code, fields: "\t".join([f"@{code}", *[f"{k}:{v}" for k, v in fields]])
    lines = [joined("HD", [("VN", ".".join(map(str, meta["version"]))), ("SO", meta["sorting"])])]
    lines += [joined("SQ", [("SN", n), ("LN", k), *more]) for n, k, more in meta["refs"]]
    lines += [joined(code, fields) for code, fields in meta["other"]] + [f"@CO\t{c}" for c in meta["comments"]]
    return "".join(f"{x}\n" for x in lines)


def combined_header(a: dict, b: dict) -> dict:
    """Lower version, the sorting if both agree, all references, and other lines without repeats."""
    once = lambda xs: [x for i, x in enumerate(xs) if x not in xs[:i]]
    return {"version": min(a["version"], b["version"]), "sorting": a["sorting"] if a["sorting"] == b["sorting"] else "unknown", "refs": a["refs"] + b["refs"], "other": once(a["other"] + b["other"]), "comments": once(a["comments"] + b["comments"])}


def with_program(meta: dict, name: str, command: str, version: str) -> dict:
    """Adds a program line with an unused id for each program that no other one follows, or one if there is none."""
    lines = [dict(f) for code, f in meta["other"] if code == "PG"]
    used, before = {x.get("ID") for x in lines}, {x.get("PP") for x in lines}
    leaves = [x["ID"] for x in lines if x.get("ID") not in before] or [None]
    added = []
    for leaf in leaves:
        own, k = name, 0
        while own in used:
            k += 1
            own = f"{name}-{k}"
        used.add(own)
        added.append(("PG", [("ID", own), ("PN", name), ("CL", command), ("VN", version), *([("PP", leaf)] if leaf else [])]))
    return meta | {"other": meta["other"] + added}


# --- records


def unpack_tags(data: bytes) -> list[dict]:
    out, i = [], 0
    while i + 3 <= len(data):
        key, t = data[i : i + 2].decode("latin-1"), chr(data[i + 2])
        i += 3
        if t in "ZH":
            end = data.index(0, i)
            value, i = data[i:end].decode("utf-8", "replace"), end + 1
        elif t == "A":
            value, i = chr(data[i]), i + 1
        elif t == "B":
            of, n = chr(data[i]), struct.unpack("<i", data[i + 1 : i + 5])[0]
            size = struct.calcsize(NUMBERS[of])
            value = ",".join([of, *[repr(x) for x in struct.unpack(f"<{n}{NUMBERS[of][1]}", data[i + 5 : i + 5 + n * size])]])
            i += 5 + n * size
        else:
            size = struct.calcsize(NUMBERS[t])
            value, i = repr(struct.unpack(NUMBERS[t], data[i : i + size])[0]), i + size
            t = "f" if t == "f" else "i"
        out.append({"key": key, "typ": t, "value": value})
    return out


def pack_tags(tags) -> bytes:
    """Whole numbers take the smallest form that holds them."""
    out = []
    for tag in tags or []:
        key, t, value = tag["key"].encode("latin-1"), tag["typ"], tag["value"]
        if t == "i":
            n = int(value)
            form = next(x for x in ("CSI" if n >= 0 else "csi") if n < 1 << 8 * struct.calcsize(NUMBERS[x]) and (n >= 0 or n >= -(1 << 8 * struct.calcsize(NUMBERS[x]) - 1)))
            out.append(key + form.encode() + struct.pack(NUMBERS[form], n))
        elif t == "f":
            out.append(key + b"f" + struct.pack("<f", float(value)))
        elif t == "A":
            out.append(key + b"A" + value.encode("latin-1")[:1])
        elif t == "B":
            of, *items = value.split(",")
            items = [float(x) if of == "f" else int(x) for x in items]
            out.append(key + b"B" + of.encode() + struct.pack(f"<i{len(items)}{NUMBERS[of][1]}", len(items), *items))
        else:
            out.append(key + t.encode() + value.encode() + b"\0")
    return b"".join(out)


def _smallest_bin(pos: int, length: int) -> int:
    end = pos + max(length, 1) - 1
    return next((base + (pos >> bits) for bits, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)) if pos >> bits == end >> bits), 0)


def unpack(data: bytes, offset: int) -> tuple:
    """A row of SCHEMA from a record's bytes; lengths that do not fit are an error."""
    row = _fields(data, offset)
    return (*row[:10], list(row[10]), *row[11:])


def _fields(data: bytes, offset: int) -> tuple:
    if len(data) < 32:
        raise ValueError("a record is shorter than its fixed part")
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, mate_ref, mate_pos, isize = struct.unpack("<IiBBHHHiIii", data[:32])
    at = 32 + n_name + 4 * n_ops
    end = at + (n_seq + 1) // 2 + n_seq
    if n_seq < 0 or end > len(data):
        raise ValueError("a record is shorter than its name, operations and bases")
    name = data[32 : 31 + n_name].decode("utf-8", "replace")
    ops = struct.unpack(f"<{n_ops}I", data[32 + n_name : at])
    bases = "".join([_HEX[b] for b in data[at : at + (n_seq + 1) // 2]])[:n_seq]
    return (name, flag, ref, pos, mapq, "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops), mate_ref, mate_pos, isize, bases, data[end - n_seq : end], unpack_tags(data[end:]), offset)


def operations(cigar: str | None) -> list[tuple[int, str]]:
    """(length, letter) of each operation."""
    out, n = [], ""
    for c in cigar or "":
        if c.isdigit():
            n += c
        else:
            out.append((int(n), c))
            n = ""
    return out


def pack(row) -> bytes:
    """A record's bytes, its size first; the bin follows from position and length."""
    ops = [(n, OPERATIONS.index(c)) for n, c in operations(row["cigar"])]
    name, seq = (row["qname"] or "").encode() + b"\0", row["seq"] or ""
    codes = [max(CODES.find(c), 0) if c in CODES else 15 for c in seq]
    length = sum(k for k, o in ops if o in (0, 2, 3, 7, 8))
    qual = bytes(row["qual"] or []) or b"\xff" * len(seq)
    body = struct.pack("<IiBBHHHiIii", row["ref_id"], row["pos"], len(name), row["mapq"], _smallest_bin(row["pos"], length) if row["pos"] >= 0 else 4680, len(ops), row["flag"], len(seq), row["mate_ref_id"], row["mate_pos"], row["isize"] or 0)
    body += name + struct.pack(f"<{len(ops)}I", *[k << 4 | o for k, o in ops])
    body += bytes(a << 4 | b for a, b in zip(codes[::2], [*codes[1::2], *([0] if len(codes) % 2 else [])])) + qual + pack_tags(row["tags"])
    return struct.pack("<I", len(body)) + body


def smallest_bins(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest bin that holds positions first to last, as `_smallest_bin` of one."""
    out = np.zeros(len(first), np.int64)
    for bits, base in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = np.where(first >> bits == last >> bits, base + (first >> bits), out)
    return out


def pieces(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all bytes of pieces of a buffer, one piece after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings, one after the other, and their sizes; null is empty."""
    a = column.cast(pa.string()).fill_null("")
    edges = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]], np.diff(edges)


def _chosen(values: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of values by their numbers, one after the other, and their sizes."""
    sizes = np.array(list(map(len, values)), np.int64)
    return np.frombuffer(b"".join(values), np.uint8)[pieces((np.cumsum(sizes) - sizes)[codes], sizes[codes])], sizes[codes]


_CODE_OF = np.full(256, 15, np.uint8)
_CODE_OF[list(CODES.encode())] = range(16)


def pack_batch(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    """The bytes of all records of a batch, as `pack` makes them, and their sizes."""
    made = _packed(batch) if batch.num_rows else (b"", np.zeros(0, np.int64))
    if made is None:
        one = [pack(row) for row in batch.to_pylist()]
        made = b"".join(one), np.array(list(map(len, one)), np.int64)
    return made


def _packed(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray] | None:
    """As `pack_batch`, by columns; None if a value is missing, too large or no plain letter, which `pack` handles or refuses."""
    n, column = batch.num_rows, {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
    head = np.zeros(n, [("size", "<u4"), *_FIXED.descr])
    fields = {c: column[c].fill_null(0) if c == "isize" else column[c] for c in ("ref_id", "pos", "mapq", "flag", "mate_ref_id", "mate_pos", "isize")}
    if any(a.null_count or not pa.types.is_integer(a.type) for a in fields.values()) or not all(pa.types.is_list(column[c].type) for c in ("qual", "tags")):
        return None
    name, n_name = _text(column["qname"])
    letters, n_seq = _text(column["seq"])
    cigar = column["cigar"].cast(pa.string()).fill_null("").dictionary_encode()
    ops_of, ops_at = [[(k, OPERATIONS.index(c)) for k, c in operations(x)] for x in cigar.dictionary.to_pylist()], cigar.indices.to_numpy()
    if any(k >= 1 << 28 for ops in ops_of for k, _ in ops):
        return None
    ops, ops_size = _chosen([struct.pack(f"<{len(x)}I", *[k << 4 | o for k, o in x]) for x in ops_of], ops_at)
    length = np.array([sum(k for k, o in x if o in (0, 2, 3, 7, 8)) for x in ops_of], np.int64)[ops_at]
    fields = {c: a.to_numpy(zero_copy_only=False).astype(np.int64) for c, a in fields.items()}
    pos = fields["pos"]
    fields |= {"n_name": n_name + 1, "n_seq": n_seq, "n_ops": ops_size // 4, "bin": np.where(pos >= 0, smallest_bins(pos, pos + np.maximum(length, 1) - 1), 4680)}
    for c, values in fields.items():
        kind = np.iinfo(_FIXED[c])
        if values.min() < kind.min or values.max() > kind.max:
            return None
        head[c] = values
    if (letters >= 128).any():
        return None
    n_bases = (n_seq + 1) // 2
    halves = np.zeros(2 * n_bases.sum(), np.uint8)
    halves[pieces(2 * (np.cumsum(n_bases) - n_bases), n_seq)] = _CODE_OF[letters]
    found, told = column["qual"].flatten(), column["qual"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if found.null_count or not pa.types.is_integer(found.type):
        return None
    found = found.to_numpy(zero_copy_only=False)
    if len(found) and (found.min() < 0 or found.max() > 255):
        return None
    n_qual = np.where(told > 0, told, n_seq)
    qual = np.full(n_qual.sum(), 255, np.uint8)
    qual[pieces(np.cumsum(n_qual) - n_qual, told)] = found
    tags, n_tags = column["tags"].flatten(), column["tags"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    each = dict(zip([f.name for f in tags.type], tags.flatten()))
    if tags.null_count or any(each[c].null_count for c in ("key", "typ", "value")):
        return None
    coded = [each[c].dictionary_encode() for c in ("key", "typ", "value")]
    number = np.zeros(len(tags), np.int64)
    for c in coded:
        number = number * max(len(c.dictionary), 1) + c.indices.to_numpy()
    _, first, tag_at = np.unique(number, return_index=True, return_inverse=True)
    kinds = [dict(zip(("key", "typ", "value"), (c.dictionary[c.indices[i].as_py()].as_py() for c in coded))) for i in first.tolist()]
    tag, tag_size = _chosen([pack_tags([x]) for x in kinds], tag_at)
    n_tag_bytes = np.diff(np.concatenate([[0], np.cumsum(tag_size)])[np.concatenate([[0], np.cumsum(n_tags)])])
    sizes = 36 + n_name + 1 + ops_size + n_bases + n_qual + n_tag_bytes
    head["size"] = sizes - 4
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(sizes.sum(), np.uint8)
    out[starts[:, None] + np.arange(36)] = head.view(np.uint8).reshape(n, 36)
    at = starts + 36
    for data, size, more in ((name, n_name, 1), (ops, ops_size, 0), (halves[::2] << 4 | halves[1::2], n_bases, 0), (qual, n_qual, 0), (tag, n_tag_bytes, 0)):
        out[pieces(at, size)] = data
        at = at + size + more
    return out.tobytes(), sizes


def read_head(stream: Stream) -> tuple[str, list[tuple[str, int]]]:
    """Header text and references (name, length); their order is that of reference numbers."""
    if stream.take(4) != MAGIC:
        raise ValueError("no BAM file: the first bytes differ")
    text = stream.take(stream.number()).rstrip(b"\0").decode("utf-8", "replace")
    refs = []
    for _ in range(stream.number()):
        name = stream.take(stream.number()).rstrip(b"\0").decode()
        refs.append((name, stream.number()))
    return text, refs


def _opened(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (fs.LocalFileSystem(), path)
    return system, inner


def stream_of(f) -> Stream | None:
    head = f.read(18)
    f.seek(0)
    kind = kind_of(head)
    if kind == "sam":
        raise ValueError("this is no BAM file; read it as text")
    return None if kind == "empty" else Stream({"bgzf": blocks, "gzip": _inflated, "plain": _plain}[kind](f))


def header_of(path: str) -> tuple[str, list[tuple[str, int]]]:
    """Header text and references of one file."""
    system, inner = _opened(path)
    with system.open_input_file(inner) as f:
        stream = stream_of(f)
        return read_head(stream) if stream else ("", [])


def _record_at(data: bytes, at: int, refs: int) -> int | None:
    """Where the record that begins at `at` ends, by its own word; None if no record can begin there, at worst beyond data."""
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, mate_ref, mate_pos = struct.unpack_from("<IiiBBHHHiii", data, at)
    if not (-1 <= ref < refs and -1 <= mate_ref < refs and pos >= -1 and mate_pos >= -1 and n_name and n_seq >= 0):
        return None
    if size < 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq:
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or any(not 32 < c < 127 for c in name[:-1])):
        return None
    ops = data[at + 36 + n_name : at + 36 + n_name + 4 * n_ops]
    if any(c & 15 > 8 for c in ops[::4]):
        return None
    return at + 4 + size


def _begins(data: bytes, at: int, refs: int, ended: bool) -> bool | None:
    """Whether records follow one another from `at` on; None if more bytes are needed to tell."""
    for _ in range(FOLLOWING):
        if at == len(data) and ended:
            return True
        if at + 36 > len(data):
            return False if ended else None
        to = _record_at(data, at, refs)
        if to is None or ended and to > len(data):
            return False
        at = to
    return True


def first_record(near: _Near, start: int, end: int, refs: int) -> tuple[int, Iterator[tuple[int, bytes]], int] | None:
    """(block, blocks from it on, place in it) of the first record that begins in a block of [start, end)."""
    place = find_block(near, start, end)
    if place is None:
        return None
    rest, held, data, at, ended = near(place), [], b"", 0, False
    limit = 0  # bytes of blocks in which a record of this stretch may begin
    while True:
        answer = None
        while at < limit and (answer := _begins(data, at, refs, ended)) is False:
            at += 1
        if at < limit and answer:
            break
        if ended or at >= limit and held and held[-1][0] >= end:
            return None
        more = next(rest, None)
        if more is None:
            ended = True
            continue
        held.append(more)
        data += more[1]
        limit = len(data) if more[0] < end else limit
    for i, (base, part) in enumerate(held):
        if at < len(part):
            return base, chain(held[i:], rest), at
        at -= len(part)
    return None


def records(f, start: int, end: int | None, split: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, bytes) of the records that begin in blocks of bytes [start, end) of a file, to its end if that is None.

    The start of the first record is found by what follows it; the task of the stretch before knows it for certain and fails
    if another one would be found, so what only looks like a record (in a tag, say) is never read as one.  Files without blocks are read whole by the stretch that begins at 0.

    split: [start, end) is many stretches of so many bytes.  The first record of each is found and held against the one that
    really comes next, as if it had a task of its own; the header is read once, and blocks where stretches meet too.
    """
    head = f.read(18)
    f.seek(0)
    stream, blocked = stream_of(f), is_bgzf(head)
    if stream is None or start and not blocked:
        return
    near = _Near(f)
    if blocked:
        stream = Stream(near(0))
    _, refs = read_head(stream)
    at = stream.offset()
    if at is None:
        return
    if start > at >> 16:  # else this stretch holds the end of the header, or what is before it
        found = first_record(near, start, end if end is not None else 1 << 62, len(refs))
        if found is None:
            return
        stream = Stream(found[1], found[2])
    if not blocked:
        yield from _until(stream, None)
        return
    inner = () if split is None else count(start + split, split) if end is None else range(start + split, end, split)
    told = at  # the last place of a record that was held against what is found
    for edge in chain(inner, [] if end is None and split else [end]):
        yield from _until(stream, None if edge is None else edge << 16)
        if edge is None or at >= edge << 16:
            continue
        true = stream.offset()  # the next stretch must find the record that really comes next
        if true != told:  # else it is the first one of several stretches
            found = first_record(near, edge, 1 << 62, len(refs))
            if true != (found and found[0] << 16 | found[2]):
                raise ValueError(f"no record can be told from others' contents after byte {edge}: read the file with another split")
            told = true
        if true is None:
            return


def _until(stream: Stream, end: int | None) -> Iterator[tuple[int, bytes]]:
    while (at := stream.offset()) is not None and (end is None or at < end):
        data, i, base = stream.data, stream.at, stream.base
        last = len(data) if end is None or base < end >> 16 else min(len(data), end & 0xFFFF)
        while i < last and i + 4 <= len(data) and (to := i + 4 + _SIZE(data, i)[0]) <= len(data):  # those that end in this block
            yield base << 16 | i, data[i + 4 : to]
            i = to
        stream.at = i
        if i < last:
            at = base << 16 | i
            yield at, stream.take(struct.unpack("<I", stream.take(4))[0])


def records_between(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, bytes) of the records from the virtual offset start on, at which one begins, to end."""
    f.seek(start >> 16)
    yield from _until(Stream(blocks(f, start >> 16), start & 0xFFFF), end)


_TAG = pa.list_(pa.struct([("key", pa.string()), ("typ", pa.string()), ("value", pa.string())]))
ARROW = pa.schema([
    ("qname", pa.string()), ("flag", pa.int32()), ("ref_id", pa.int64()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_ref_id", pa.int64()),
    ("mate_pos", pa.int32()), ("isize", pa.int32()), ("seq", pa.string()), ("qual", pa.list_(pa.int32())), ("tags", _TAG), ("virt_offset", pa.int64()),
])


def fixed_parts(found: Iterable[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of records: all their bytes, their fixed parts, and a row of places each: of the record, its name's end, operations,
    bases, qualities, tags and the end.  Lengths that do not fit are an error."""
    parts = list(found)
    data, sizes = b"".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    if (sizes < 32).any():
        raise ValueError("a record is shorter than its fixed part")
    fixed = np.frombuffer(data, np.uint8)[starts[:, None] + np.arange(32)].view(_FIXED)[:, 0]
    n_name, n_ops, n_seq = (fixed[c].astype(np.int64) for c in ("n_name", "n_ops", "n_seq"))
    ops = starts + 32 + n_name
    seq = ops + 4 * n_ops
    qual = seq + (n_seq + 1) // 2
    tags = qual + n_seq
    if (n_seq < 0).any() or (tags > starts + sizes).any():
        raise ValueError("a record is shorter than its name, operations and bases")
    return data, fixed, np.stack([starts, np.maximum(ops - 1, starts + 32), ops, seq, qual, tags, starts + sizes])


def alike(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different pieces of a buffer, and the number of each piece among them."""
    ids: dict[bytes, int] = {}
    codes = [ids.setdefault(data[a:b], len(ids)) for a, b in zip(starts.tolist(), ends.tolist())]
    return list(ids), np.array(codes, np.int32)


def show_operations(packed: bytes) -> str:
    return "".join([f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack(f"<{len(packed) // 4}I", packed)])


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings from their bytes, one after the other."""
    edges = np.cumsum([0, *sizes])
    if (data >= 128).any():
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])], pa.string())
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data))


_PAIRS = np.frombuffer("".join(_HEX).encode(), np.uint8).reshape(256, 2)


def batches(found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Records as Arrow batches of SCHEMA; operations and tags that are alike in a batch are read once."""
    while rows := list(islice(found, BATCH)):
        data, fixed, (starts, name, ops, seq, qual, tags, ends) = fixed_parts(x for _, x in rows)
        raw, n_seq = np.frombuffer(data, np.uint8), tags - qual
        letters = _PAIRS[raw[pieces(seq, qual - seq)]].reshape(-1)
        odd = np.cumsum(2 * (qual - seq))[n_seq % 2 == 1] - 1  # the letter behind the last base
        quals = raw[pieces(qual, n_seq)].astype(np.int32)
        ops_of, ops_at = alike(data, ops, seq)
        tags_of, tags_at = alike(data, tags, ends)
        made = {
            "qname": _strings(raw[pieces(starts + 32, name - starts - 32)], name - starts - 32),
            "cigar": pa.array(map(show_operations, ops_of), pa.string()).take(pa.array(ops_at)),
            "seq": _strings(np.delete(letters, odd), n_seq),
            "qual": pa.ListArray.from_arrays(np.cumsum([0, *n_seq]).astype(np.int32), quals),
            "tags": pa.array(map(unpack_tags, tags_of), _TAG).take(pa.array(tags_at)),
            "virt_offset": pa.array([at for at, _ in rows], pa.int64()),
        }
        arrays = [made[f.name] if f.name in made else pa.array(fixed[f.name].astype(f.type.to_pandas_dtype())) for f in ARROW]
        yield pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder but indexes; several paths stand in lines."""
    if "\n" in path:
        return [x for p in path.split("\n") for x in files_of(p)]
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [x for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")) and not x.base_name.endswith((".bai", ".csi"))]
    return [(f"{path.rstrip('/')}/{x.base_name}", x.size) for x in sorted(found, key=lambda x: x.path)]


def shared(files: list[tuple[str, int]], split: int) -> Iterator[tuple[str, int, int]]:
    """(path, start, end) of what a task reads of each file (path, bytes): one stretch of `split` bytes, or several that follow
    one another if there are more than TASKS."""
    most = max(1, min(SPLIT, sum(size for _, size in files) // TASKS) // split) * split
    return ((p, a, min(a + most, size)) for p, size in files for a in range(0, max(size, 1), most))


def stretches(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, start, end) in bytes: what tasks read of each file, one task a row; see `shared`."""
    rows = list(shared(files_of(path), split))
    return spark.createDataFrame(rows, "path string, start long, end long").coalesce(1).repartition(max(1, len(rows)))


def read_places(places: DataFrame) -> DataFrame:
    """Records of SCHEMA between virtual offsets (path, start, end), each a stretch that begins with a record."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for path, start, end in zip(*(b.column(i).to_pylist() for i in range(3))):
                system, inner = _opened(path)
                with system.open_input_file(inner) as f:
                    yield from batches(records_between(f, start, end))

    return places.select("path", "start", "end").mapInArrow(run, SCHEMA)


class _Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, virtual: bool = False):
        super().__init__((path, start, end, virtual))


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.refs, self.low, self.high = path, split, None, 0, None

    def pushFilters(self, filters):
        for x in filters:
            number = isinstance(getattr(x, "value", None), int) or isinstance(x, In)
            if number and x.attribute == ("ref_id",) and isinstance(x, (EqualTo, In)):
                own = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.refs = own if self.refs is None else self.refs & own
            elif number and x.attribute == ("pos",):
                low = {EqualTo: 0, GreaterThanOrEqual: 0, GreaterThan: 1}.get(type(x))
                high = {EqualTo: 1, LessThanOrEqual: 1, LessThan: 0}.get(type(x))
                if low is not None:
                    self.low = max(self.low, x.value + low)
                if high is not None:
                    self.high = min(x.value + high, self.high if self.high is not None else x.value + high)
            yield x  # Spark tests them too

    def partitions(self):
        out, whole = [], []
        for path, size in files_of(self.path):
            places = self._places(path)
            if places is not None:
                out += [_Stretch(path, a, b, True) for a, b in places]
            else:
                whole.append((path, size))
        sizes = dict(whole)
        return out + [_Stretch(path, a, b if b < sizes[path] else None) for path, a, b in shared(whole, self.split)]

    def _places(self, path: str) -> list[tuple[int, int]] | None:
        """What an index says of the asked references; None without filters on them or without an index."""
        from . import index

        asked = {r for r in self.refs or () if isinstance(r, int) and 0 <= r < 1 << 31}
        if self.refs is None or len(asked) < len(self.refs):
            return None
        system, inner = _opened(path + ".bai")
        if system.get_file_info(inner).type != fs.FileType.File:
            return None
        with system.open_input_file(inner) as f:
            rows = list(index.parse(f.read()))
        return sorted(x for r in asked for x in index.places(rows, r, self.low, self.high if self.high is not None else 1 << 29, self.split))

    def read(self, partition):
        if partition is None:
            return
        path, start, end, virtual = partition.value
        system, inner = _opened(path)
        with system.open_input_file(inner) as f:
            yield from batches(records_between(f, start, end) if virtual else records(f, start, end, self.split))


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class BamWriter(DataSourceArrowWriter):
    def __init__(self, path: str, header: str, level: int, overwrite: bool):
        self.path, self.header, self.level, self.overwrite, self.temporary = path.rstrip("/"), header, level, overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, inner = _opened(self.path)
        system.create_dir(f"{inner}/{self.temporary}", recursive=True)
        name = f"part-{uuid.uuid4().hex}.bam"
        text, refs = self.header.encode(), parse_header(self.header)["refs"]
        head = MAGIC + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
        head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k, _ in refs)
        with system.open_output_stream(f"{inner}/{self.temporary}/{name}", compression=None) as f:
            for i in range(0, len(head), MOST_BYTES):
                f.write(block(head[i : i + MOST_BYTES], self.level))
            held = bytearray()
            for batch in iterator:
                data, sizes = pack_batch(batch)
                ends, i, at = np.cumsum(sizes), 0, 0
                while i < len(ends):
                    j = int(np.searchsorted(ends, at + MOST_BYTES - len(held), "right"))
                    if j == i and held:  # a block begins with a record, if records are not longer
                        f.write(block(bytes(held), self.level))
                        held = bytearray()
                        continue
                    j = max(j, i + 1)
                    held += data[at : ends[j - 1]]
                    i, at = j, int(ends[j - 1])
                    while len(held) > MOST_BYTES:
                        f.write(block(bytes(held[:MOST_BYTES]), self.level))
                        del held[:MOST_BYTES]
            if held:
                f.write(block(bytes(held), self.level))
            f.write(block(b""))
        return _Written(name)

    def commit(self, messages):
        system, inner = _opened(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                if x.type == fs.FileType.File and x.base_name.endswith(".bam"):
                    system.delete_file(x.path)
        for m in messages:
            if m is not None:
                system.move(f"{inner}/{self.temporary}/{m.name}", f"{inner}/{m.name}")
        self.abort(messages)

    def abort(self, messages):
        system, inner = _opened(self.path)
        if system.get_file_info(f"{inner}/{self.temporary}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.temporary}")


class BamSource(DataSource):
    """Options of the reader: split (bytes of a file for a task), paths (several, in lines).  Options of the writer: header (text with @SQ lines, in the order of reference numbers), level (0 to 9)."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options.get("paths") or self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite):
        return BamWriter(self.options["path"], self.options.get("header", ""), int(self.options.get("level", "6")), overwrite)


def refs_header(refs: list[tuple[str, int]], sorting: str = "unknown") -> str:
    return show_header({"version": (1, 6), "sorting": sorting, "refs": [(n, k, []) for n, k in refs], "other": [], "comments": []})


