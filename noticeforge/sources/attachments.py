"""Texts of uploaded files, read with the standard library only: TXT, MD, HWPX and HWP; PDF where its library is installed."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Fixed values of the HWP record format: the tag of paragraph text, and control characters that take eight units.
PARA_TEXT = 67
WIDE_CONTROLS = frozenset((1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23))


def plain_text(data: bytes) -> str:
    """UTF-8, else the Korean code page, else UTF-8 without what does not fit."""
    for codec in ("utf-8", "cp949"):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


def hwpx_sections(data: bytes) -> list[str]:
    """The sections of a HWPX archive by number: each paragraph a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n))]
        out = []
        for _, name in sorted(names):
            lines = []
            for p in ElementTree.fromstring(archive.read(name)).iter():
                if p.tag.rpartition("}")[2] == "p":
                    lines.append("".join(t.text or "" for t in p.iter() if t.tag.rpartition("}")[2] == "t"))
            out.append("\n".join(x for x in lines if x))
    return out


def hwp_paragraph(data: bytes) -> str:
    """The text of one UTF-16 paragraph record; 10 and 13 are line feeds, other control characters and their data are left out."""
    units = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2])
    out, i = [], 0
    while i < len(units):
        u = units[i]
        if u in WIDE_CONTROLS:
            i += 8
            continue
        if u in (10, 13):
            out.append(10)
        elif u >= 32:
            out.append(u)
        i += 1
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "ignore")


def hwp_section(data: bytes, packed: bool = True) -> str:
    """The paragraphs of a section stream: records of tag, level and size (a size of 0xFFF is in the next four bytes)."""
    if packed:
        data = zlib.decompress(data, -15)
    out, at = [], 0
    while at + 4 <= len(data):
        (head,) = struct.unpack_from("<I", data, at)
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                break
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        if head & 0x3FF == PARA_TEXT:
            out.append(hwp_paragraph(data[at : at + size]).strip("\n"))
        at += size
    return "\n".join(x for x in out if x)


class Unreadable(Exception):
    """A file that can't be read, with the code that says why."""


#: Fixed values of the compound file format: its signature, and marks in its tables.
_MAGIC, _FREE, _ROOT, _STREAM = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFA, 5, 2


class Compound:
    """The streams of a compound file (OLE 2): a file system of sectors in a file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != _MAGIC or len(data) < 512:
            raise Unreadable("HWP_PARSE_FAILED")
        self.data, self.size, small = data, 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        start, _, self.cutoff, mini_start, _, more, n_more = struct.unpack_from("<IIIIIII", data, 48)
        table = [*struct.unpack_from("<109I", data, 76)]
        for _ in range(min(n_more, len(data) // self.size)):
            part = self._sector(more)
            table += struct.unpack(f"<{self.size // 4 - 1}I", part[: self.size - 4])
            (more,) = struct.unpack_from("<I", part, self.size - 4)
        self.fat = [n for t in table if t < _FREE for n in struct.unpack(f"<{self.size // 4}I", self._sector(t))]
        entries = self._chain(start, self.fat, self._sector)
        self.entries = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        mini = self._chain(mini_start, self.fat, self._sector)
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])
        first, length = struct.unpack_from("<II", self.entries[0], 116)
        pool = self._chain(first, self.fat, self._sector)[:length]
        self._mini = lambda n: pool[n * small : (n + 1) * small]

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if at + self.size > len(self.data) + self.size - 1:
            raise Unreadable("HWP_PARSE_FAILED")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    @staticmethod
    def _chain(n: int, table, read) -> bytes:  # noqa: ANN001
        out, left = [], len(table)
        while n < _FREE:
            if left < 0 or n >= len(table):
                raise Unreadable("HWP_PARSE_FAILED")
            out.append(read(n))
            n, left = table[n], left - 1
        return b"".join(out)

    def streams(self) -> dict[str, bytes]:
        """Path -> content of every stream; the root has no name."""
        out: dict[str, bytes] = {}
        todo, seen = [(struct.unpack_from("<I", self.entries[0], 76)[0], "")], set()
        while todo:
            n, path = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            e = self.entries[n]
            length = struct.unpack_from("<H", e, 64)[0]
            name = path + e[: max(0, length - 2)].decode("utf-16-le", "replace")
            left, right, child, first, size = struct.unpack_from("<III", e, 68) + struct.unpack_from("<II", e, 116)
            todo += [(left, path), (right, path)]
            if e[66] == _STREAM:
                chain = self._chain(first, self.mini_fat, self._mini) if size < self.cutoff else self._chain(first, self.fat, self._sector)
                out[name] = chain[:size]
            else:
                todo.append((child, name + "/"))
        return out


def hwp_sections(data: bytes) -> list[str]:
    """The sections of a HWP 5 file by number; locked files can't be read."""
    streams = Compound(data).streams()
    head = streams.get("FileHeader", b"")
    if len(head) < 40:
        raise Unreadable("HWP_PARSE_FAILED")
    flags = int.from_bytes(head[36:40], "little")
    if flags & 2:
        raise Unreadable("HWP_ENCRYPTED")
    names = sorted((int(m[1]), n) for n in streams if (m := re.fullmatch(r"BodyText/Section(\d+)", n)))
    if not names:
        raise Unreadable("HWP_PARSE_FAILED")
    return [hwp_section(streams[n], bool(flags & 1)) for _, n in names]


def pdf_pages(data: bytes) -> list[str]:
    """The texts of a PDF's pages, an empty one for a page without text; needs the optional library pdfplumber."""
    try:
        import pdfplumber
    except ImportError as error:
        raise Unreadable("PDF_BACKEND_MISSING") from error
    try:
        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return [page.extract_text() or "" for page in pdf.pages]
    except Exception as error:
        raise Unreadable("PDF_PARSE_FAILED") from error


#: Readers by suffix, with whether their units are pages, and the code where one fails in a way of its own. Others may be registered.
READERS: dict[str, tuple[Callable[[bytes], list[str]], bool, str]] = {
    ".txt": (lambda d: [plain_text(d)], False, "TEXT_PARSE_FAILED"), ".md": (lambda d: [plain_text(d)], False, "TEXT_PARSE_FAILED"), ".hwpx": (hwpx_sections, False, "HWPX_PARSE_FAILED"),
    ".hwp": (hwp_sections, False, "HWP_PARSE_FAILED"), ".pdf": (pdf_pages, True, "PDF_PARSE_FAILED"),
}
_RESULT = T.StructType([T.StructField("units", T.ArrayType(T.StringType())), T.StructField("paged", T.BooleanType()), T.StructField("error_code", T.StringType())])


def suffix(path: str | None) -> str:
    """The suffix of a file's name in lower case; a dot at its beginning makes none."""
    return PurePosixPath(path or "").suffix.lower()


def read_file(path: str | None, data: bytes | None) -> dict:
    """units, paged, error_code of one file; an error leaves no units."""
    reader, paged, failed = READERS.get(suffix(path), (None, False, None))
    if reader is None:
        return {"units": None, "paged": False, "error_code": "UNSUPPORTED_FILE_TYPE"}
    try:
        units = list(reader(data or b""))
    except Unreadable as error:
        return {"units": None, "paged": paged, "error_code": str(error)}
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, OverflowError, zlib.error, struct.error):
        return {"units": None, "paged": paged, "error_code": failed}
    return {"units": units, "paged": paged, "error_code": None if any(u.strip() for u in units) else "EMPTY_CONTENT"}


@arrow_udf(_RESULT)
def _read(paths: pa.Array, contents: pa.Array) -> pa.Array:
    rows = [read_file(p, d) for p, d in zip(paths.to_pylist(), contents.to_pylist(), strict=True)]
    return pa.array(rows, pa.struct([("units", pa.list_(pa.string())), ("paged", pa.bool_()), ("error_code", pa.string())]))


def read_files(files: DataFrame) -> DataFrame:
    """files (path, content: as of the binaryFile source) with units, paged and error_code; a file that can't be read has no units."""
    told = files.withColumn("__r", _read("path", "content"))
    return told.select(*files.columns, F.col("__r.units").alias("units"), F.col("__r.paged").alias("paged"), F.col("__r.error_code").alias("error_code"))
