"""Class files in archives as model rows: one row for each class, member, reference and constant.

Archives are read by the binary file source; each is opened and parsed in the task that reads it. A row is (archive, kind, owner, id,
name, other, flags, value): kind says which of the columns are used. A file that isn't a class file, or an archive that can't be opened,
gives one row of kind "rejected".

Kinds: class (other is its parent), implements (id is its place), outer, field, method, signature (value, of the class or member that is the owner), the constants string, int,
long, float and double, calls, reads, writes and "class ref" (other), code (id is the place, flags the opcode, name the slot of an instruction on a
variable, or what a dynamic call would call: then other is its maker, and value the maker's tag and whether it is an interface's), jump (id is the place, value a place that may be next),
site (id is the place of a dynamic call, value its descriptor), handler (id is the first place of a range, flags the one after its last, value the handler's), and local (id is the place in the table of
variables, name and other the variable's name and type, flags its slot, value the number of instructions before its range). An instruction's value is what it is compared by: a constant with its type,
the sign of a jump, the bounds or keys of a switch, an increment, or a number of dimensions. A wide instruction has the opcode of the one it widens.
"""

from __future__ import annotations

import bisect
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "archive string, kind string, owner string, id string, name string, other string, flags int, value string"

# What follows a tag in the constant pool, and instructions that hold operands, by their lengths.
POOL = {3: ">i", 4: ">f", 5: ">q", 6: ">d", 7: ">H", 8: ">H", 9: ">HH", 10: ">HH", 11: ">HH", 12: ">HH", 15: ">BH", 16: ">H", 17: ">HH", 18: ">HH", 19: ">H", 20: ">H"}
NUMBERS = {3: "int", 4: "float", 5: "long", 6: "double"}
ONE_BYTE = {16, 18, *range(21, 26), *range(54, 59), 169, 188}
TWO_BYTES = {17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199}
FOUR_BYTES = {185, 186, 200, 201}
CALLS, READS, WRITES = {182, 183, 184, 185}, {178, 180}, {179, 181}
TYPES = {187, 189, 192, 193, 197}
DYNAMIC = 186
#: Instructions on variables with the slot behind them, and the first of each four that have it in themselves.
SLOT_BEHIND = {*range(21, 26), *range(54, 59), 132, 169}
SLOT_INSIDE = (*range(26, 46, 4), *range(59, 79, 4))
JUMPS, WIDE_JUMPS, WIDE = {*range(153, 169), 198, 199}, {200, 201}, 196
BATCH_ROWS = 20_000


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        values = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return values[0] if len(values) == 1 else values


def constant_pool(r: Reader) -> list:
    pool: list = [None] * r.take(">H")
    i = 1
    while i < len(pool):
        tag = r.take(">B")
        if tag == 1:
            size = r.take(">H")
            pool[i] = (1, r.data[r.at : r.at + size].decode("utf-8", "surrogatepass" if b"\xed" in r.data[r.at : r.at + size] else "replace"))
            r.at += size
        else:
            pool[i] = (tag, r.take(POOL[tag]))
        i += 2 if tag in (5, 6) else 1
    return pool


def instructions(code: bytes) -> Iterator[tuple[int, int, int]]:
    """(place, opcode, place of its operands)."""
    at = 0
    while at < len(code):
        op = code[at]
        yield at, op, at + 1
        if op == 170:
            base = (at + 4) & ~3
            low, high = struct.unpack_from(">ii", code, base + 4)
            at = base + 12 + 4 * (high - low + 1)
        elif op == 171:
            base = (at + 4) & ~3
            at = base + 8 + 8 * struct.unpack_from(">i", code, base + 4)[0]
        elif op == 196:
            at += 6 if code[at + 1] == 132 else 4
        else:
            at += 1 + (1 if op in ONE_BYTE else 2 if op in TWO_BYTES else 3 if op == 197 else 4 if op in FOUR_BYTES else 0)


def rows_of(archive: str, data: bytes) -> list[tuple]:
    """Rows of one class file."""
    r = Reader(data)
    if r.take(">I") != 0xCAFEBABE:
        raise ValueError("not a class file")
    r.take(">HH")
    pool = constant_pool(r)

    def text(i: int) -> str | None:
        return pool[i][1] if i else None

    def cls(i: int) -> str | None:
        return text(pool[i][1]) if i else None

    def attributes(r: Reader = r) -> dict[str, bytes]:
        found = {}
        for _ in range(r.take(">H")):
            name, size = r.take(">HI")
            found[text(name)] = r.data[r.at : r.at + size]
            r.at += size
        return found

    def signature(owner: str, found: dict[str, bytes]) -> list[tuple]:
        return [(archive, "signature", owner, None, None, None, None, text(struct.unpack(">H", found["Signature"])[0]))] if "Signature" in found else []

    def handle(i: int) -> tuple[int, str, bool]:
        """(tag, class/name and descriptor, whether of an interface) of a method handle."""
        tag, place = pool[i][1]
        holder, named = pool[place][1]
        name, desc = pool[named][1]
        return tag, f"{cls(holder)}/{text(name)}{';;' if tag < 5 else ''}{text(desc)}", pool[place][0] == 11

    flags, this, parent = r.take(">HHH")
    me = cls(this)
    out = [(archive, "class", None, me, me, cls(parent), flags, None)]
    for place in range(r.take(">H")):
        out.append((archive, "implements", me, str(place), None, cls(r.take(">H")), None, None))
    bodies = []
    for kind in ("field", "method"):
        for place in range(r.take(">H")):
            access, name, desc = r.take(">HHH")
            member = f"{text(name)};;{text(desc)}" if kind == "field" else f"{text(name)}{text(desc)}"
            found = attributes()
            out.append((archive, kind, me, member, text(name), text(desc), access, str(place)))
            owner = f"{me}/{member}"
            if "ConstantValue" in found:
                tag, value = pool[struct.unpack(">H", found["ConstantValue"])[0]]
                out.append((archive, NUMBERS.get(tag, "string"), owner, None, None, None, None, text(value) if tag == 8 else str(value)))
            out += signature(owner, found)
            if "Code" in found:
                bodies.append((owner, found["Code"]))
    found = attributes()
    makers = bootstraps(found.get("BootstrapMethods", b"\0\0"), handle, pool)
    for owner, body in bodies:
        size = struct.unpack_from(">I", body, 4)[0]
        code = body[8 : 8 + size]
        out += code_rows(archive, owner, code, pool, text, cls, makers)
        out += handler_rows(archive, owner, code, body[8 + size :])
        rest = Reader(body)
        rest.at = 8 + size
        rest.at += 2 + 8 * struct.unpack_from(">H", body, rest.at)[0]
        out += local_rows(archive, owner, code, attributes(rest).get("LocalVariableTable", b"\0\0"), text)
    out += signature(me, found)
    if "EnclosingMethod" in found:
        out.append((archive, "outer", me, None, None, cls(struct.unpack_from(">H", found["EnclosingMethod"])[0]), None, None))
    elif "InnerClasses" in found:
        inner = found["InnerClasses"]
        for i in range(struct.unpack_from(">H", inner)[0]):
            own, outer = struct.unpack_from(">HH", inner, 2 + 8 * i)
            if cls(own) == me and outer:
                out.append((archive, "outer", me, None, None, cls(outer), None, None))
    return out


def bootstraps(data: bytes, handle, pool: list) -> list[tuple]:
    """(maker's handle, second argument as a handle or null) of each entry of the table of makers."""
    r, out = Reader(data), []
    for _ in range(r.take(">H")):
        maker, n = r.take(">HH")
        arguments = [r.take(">H") for _ in range(n)]
        out.append((handle(maker), handle(arguments[1])[1] if n > 1 and pool[arguments[1]][0] == 15 else None))
    return out


def local_rows(archive: str, owner: str, code: bytes, table: bytes, text) -> list[tuple]:
    """The table of variables, with the number of instructions before each range in place of its first byte."""
    starts = [at for at, _, _ in instructions(code)]
    r, out = Reader(table), []
    for entry in range(r.take(">H")):
        start, _, name, desc, slot = r.take(">HHHHH")
        out.append((archive, "local", owner, str(entry), text(name), text(desc), slot, str(bisect.bisect_left(starts, start))))
    return out


def handler_rows(archive: str, owner: str, code: bytes, table: bytes) -> list[tuple]:
    """The ranges of places that a handler is for."""
    starts = [at for at, _, _ in instructions(code)]
    out = []
    for entry in range(struct.unpack_from(">H", table)[0]):
        first, end, handler = (bisect.bisect_left(starts, p) for p in struct.unpack_from(">HHH", table, 2 + 8 * entry))
        out.append((archive, "handler", owner, str(first), None, None, end, str(handler)))
    return out


def targets_of(code: bytes, at: int, op: int, operands: int) -> tuple[list[int], str | None]:
    """Bytes that a jump or a switch may lead to, and what it is compared by."""
    if op in JUMPS or op in WIDE_JUMPS:
        by = struct.unpack_from(">h" if op in JUMPS else ">i", code, operands)[0]
        return [at + by], str((by > 0) - (by < 0))
    base = (at + 4) & ~3
    if op == 170:
        default, low, high = struct.unpack_from(">iii", code, base)
        return [at + by for by in (default, *struct.unpack_from(f">{high - low + 1}i", code, base + 12))], f"{low} {high}"
    default, n = struct.unpack_from(">ii", code, base)
    pairs = struct.unpack_from(f">{2 * n}i", code, base + 8)
    return [at + by for by in (default, *pairs[1::2])], " ".join(map(str, pairs[::2]))


def slot_of(code: bytes, op: int, operands: int) -> str | None:
    """The slot of an instruction on a variable."""
    if op == WIDE:
        return str(struct.unpack_from(">H", code, operands + 1)[0])
    if op in SLOT_BEHIND:
        return str(code[operands])
    return next((str(op - first) for first in SLOT_INSIDE if first <= op < first + 4), None)


def code_rows(archive: str, owner: str, code: bytes, pool: list, text, cls, makers: list[tuple] = ()) -> list[tuple]:
    """Instructions in order, and what they refer to."""
    out = []
    starts = {at: place for place, (at, _, _) in enumerate(instructions(code))}
    for place, (at, op, operands) in enumerate(instructions(code)):
        kind, other, value, name_, told = None, None, None, slot_of(code, op, operands), None
        if op == WIDE:
            op, told = code[operands], str(struct.unpack_from(">h", code, operands + 3)[0]) if code[operands] == 132 else None
        elif op == 132:
            told = str(struct.unpack_from(">b", code, operands + 1)[0])
        elif op in JUMPS or op in WIDE_JUMPS or op in (170, 171):
            to, told = targets_of(code, at, op, operands)
            out += [(archive, "jump", owner, str(place), None, None, None, str(starts[t])) for t in to]
        if op in CALLS | READS | WRITES:
            holder, named = pool[struct.unpack_from(">H", code, operands)[0]][1]
            name, desc = pool[named][1]
            kind = "calls" if op in CALLS else "reads" if op in READS else "writes"
            other = f"{cls(holder)}/{text(name)}{'' if op in CALLS else ';;'}{text(desc)}"
        elif op in TYPES:
            kind, other = "class ref", cls(struct.unpack_from(">H", code, operands)[0])
            told = str(code[operands + 2]) if op == 197 else None
        elif op in (18, 19, 20):
            tag, raw = pool[code[operands] if op == 18 else struct.unpack_from(">H", code, operands)[0]]
            kind = "string" if tag == 8 else "class ref" if tag == 7 else NUMBERS.get(tag)
            other, value = (text(raw), None) if tag == 7 else (None, text(raw) if tag == 8 else str(raw))
            told = f"{kind or tag} {value or ''}"
        elif op == DYNAMIC:
            entry, named = pool[struct.unpack_from(">H", code, operands)[0]][1]
            (tag, maker, interface), target = makers[entry]
            name_, other, value = target, maker, f"{tag} {str(interface).lower()}"
            out.append((archive, "site", owner, str(place), None, None, None, text(pool[named][1][1])))
        elif op in (16, 17, 188):
            kind, value = "int", str(struct.unpack_from(">h" if op == 17 else ">b", code, operands)[0])
        out.append((archive, "code", owner, str(place), name_, other, op, value if told is None else told))
        if kind:
            out.append((archive, kind, owner, None, None, other, None, value))
    return out


def content_of(archive: zipfile.ZipFile, name: str) -> bytes | Exception:
    """Bytes of an entry, or the error that keeps it from being read."""
    try:
        return archive.read(name)
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, KeyError) as error:
        return error


def entries(data: bytes) -> Iterator[tuple[str | None, bytes | Exception]]:
    """(name, bytes) of the class files in an archive, or of a single file; what can't be opened has its error in place of bytes."""
    if data[:2] != b"PK":
        yield None, data
        return
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for name in archive.namelist():
                if name.endswith(".class"):
                    yield name, content_of(archive, name)
    except zipfile.BadZipFile as error:
        yield None, error


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.int32() if n == "flags" else pa.string() for n in names]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def batches_of(archive: str, found: Iterator[tuple[str | None, bytes | Exception]]) -> Iterator[pa.RecordBatch]:
    """Rows of class files (name, bytes), in batches of about ``BATCH_ROWS``; one that can't be parsed is a row of kind "rejected"."""
    rows: list[tuple] = []
    for name, body in found:
        try:
            if isinstance(body, Exception):
                raise ValueError(str(body))
            rows += rows_of(archive, body)
        except (ValueError, IndexError, KeyError, TypeError, struct.error) as error:
            rows.append((archive, "rejected", None, name, None, None, None, str(error)))
        if len(rows) > BATCH_ROWS:
            yield batch_of(rows)
            rows = []
    yield batch_of(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all class files in archives or single files under ``path``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from batches_of(path_, entries(content.as_py()))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(parse, SCHEMA)
