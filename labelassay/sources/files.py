"""Documents and photos from files: text of DOCX with the standard library, others by optional adapters."""

from __future__ import annotations

import gc
import io
import posixpath
import re
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import ARROW_LIMITS, scratch_path, settings

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Body paragraphs, a line each; tables and headers aren't visited."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    out = []
    for paragraph in body.findall(f"{WORD}p") if body is not None else []:
        parts = []
        for node in paragraph.iter():
            if node.tag == f"{WORD}t":
                parts.append(node.text or "")
            elif node.tag == f"{WORD}tab":
                parts.append("\t")
            elif node.tag in (f"{WORD}br", f"{WORD}cr"):
                parts.append("\n")
        out.append("".join(parts))
    return "\n".join(out)


RELATIONSHIP = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def docx_images(content: bytes) -> list[bytes]:
    """What the document's image relationships point to inside the file, in their order; one that isn't there is left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        try:
            relations = ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))
        except KeyError:
            return []
        out = []
        for r in relations.findall(RELATIONSHIP):
            if "image" in r.get("Type", "") and r.get("TargetMode") != "External":
                name = posixpath.normpath(posixpath.join("word", r.get("Target", ""))).lstrip("/")
                try:
                    out.append(z.read(name))
                except KeyError:
                    continue
        return out


def pdf_images(content: bytes) -> list[bytes]:
    """Images of all pages; a page or image that can't be read is left out."""
    out = []
    for page in _pdf_reader(content).pages:
        try:
            images = list(page.images)
        except Exception:  # readers raise errors of many kinds on broken pages
            continue
        out += [i.data for i in images]
    return out


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF or JPEG file, else null."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            if 0xC0 <= content[at + 1] <= 0xCF and content[at + 1] not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return width, height
            at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def _pdf_reader(content: bytes):
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("Reading PDF needs pypdf") from None
    reader = PdfReader(io.BytesIO(content))
    if reader.is_encrypted and not reader.decrypt(""):
        raise ValueError("The PDF is locked")
    return reader


def pdf_text(content: bytes) -> str:
    return "\n".join(page.extract_text() or "" for page in _pdf_reader(content).pages)


READERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "pdf": pdf_text}
IMAGES: dict[str, Callable[[bytes], list[bytes]]] = {"docx": docx_images, "pdf": pdf_images}


#: The largest file that is opened.
MOST_BYTES = 60 << 20


def _of_kinds(kinds: Iterable[str]) -> str:
    """A file name pattern for some extensions, in capitals or not."""
    any_case = lambda kind: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in kind)
    return "*.{" + ",".join(map(any_case, sorted(kinds))) + "}"


def _scan(spark: SparkSession, path: str | list[str], names: str | None = None) -> DataFrame:
    """path, kind (the extension), length and content of all files in a folder and those below it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", names) if names else reader).load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), "length", "content")


def document_files(spark: SparkSession, path: str | list[str], kinds: Iterable[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, kind and content of the files in a folder that a reader opens.

    Other extensions are left out when files are listed, and larger files by a
    filter that the scan gets, before a byte of them is read. Files are dealt to tasks by their sizes.
    """
    return _scan(spark, path, _of_kinds(READERS if kinds is None else kinds)).where(F.col("length") <= most_bytes).select("path", "kind", "content")


def read_documents(spark: SparkSession, path: str | list[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, text and error of all files in a folder (or some), by their extension.

    What isn't opened (another kind, or more than ``most_bytes``) has its error;
    that scan reads no contents.
    """
    opened = texts_of(document_files(spark, path, most_bytes=most_bytes))
    known = F.col("kind").isin(*READERS)
    error = F.when(known, F.concat(F.lit("File is larger than "), F.lit(str(most_bytes)), F.lit(" bytes"))).otherwise(F.concat(F.lit("Unsupported document type: ."), "kind"))
    others = _scan(spark, path).where(~known | (F.col("length") > most_bytes))
    return opened.unionByName(others.select("path", F.lit(None).cast("string").alias("text"), error.alias("error")))


#: A scan counts each file as this many bytes at least; Spark's 4 MB would make a task for 32 small files.
OPEN_COST = {"spark.sql.files.openCostInBytes": str(64 << 10)}
#: Spark's driver keeps up to 250 MB of lists of files for scans of a table's partitions; no list of these is asked for again.
NO_LISTS_KEPT = {"spark.sql.hive.filesourcePartitionFileCacheSize": "0"}


def read_folders(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, at_once: int = 8, files_at_once: int = 4096) -> DataFrame:
    """``read_documents`` of a folder of any number of files, of which each folder in it holds some thousands.

    A scan's list of files is the driver's, so no scan has them all: ``at_once`` folders, or
    ``files_at_once`` of the files beside them, are read and written to the shared folder, then the next.
    A file in a list costs the driver about 0.8 KB, and a round has two lists. What Python holds of a round
    is collected at its end, as Spark's driver can't drop the lists before.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatusIterator(root)
    found = scratch_path(spark, "documents-read")
    schema = "path string, text string, error string"
    spark.createDataFrame([], schema).write.parquet(found)

    def read(paths: list[str]) -> None:
        if paths:
            plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]  # load() takes patterns
            with settings(spark, ARROW_LIMITS | OPEN_COST | NO_LISTS_KEPT):
                read_documents(spark, plain, most_bytes).write.mode("append").parquet(found)
            paths.clear()
            gc.collect()

    folders, loose = [], []
    while entries.hasNext():
        entry = entries.next()
        if not entry.getPath().getName().startswith((".", "_")):  # Spark's readers pass over these too
            among, most = (folders, at_once) if entry.isDirectory() else (loose, files_at_once)
            among.append(entry.getPath().toString())
            if len(among) >= most:
                read(among)
    read(folders)
    read(loose)
    return spark.read.schema(schema).parquet(found)


def read_images(spark: SparkSession, path: str, side: int = 150, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, number, width, height and image of the photos inside the files of a folder (see ``images_of``)."""
    return images_of(document_files(spark, path, IMAGES, most_bytes), side)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each row's ``content`` as the file ``name`` into a folder of a shared store; name and bytes of each.

    A file gets its name when it is whole, so a task may run twice. A name may begin with a folder's.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        there = set()
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                inside = posixpath.dirname(name)
                if inside and inside not in there:
                    store.create_dir(f"{root}/{inside}", recursive=True)
                    there.add(inside)
                part = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{root}/{name}")
            yield pd.DataFrame({"name": batch["name"], "bytes": batch["content"].map(len)})

    return files.select("name", "content").mapInPandas(write, "name string, bytes long")


def texts_of(files: DataFrame) -> DataFrame:
    """path, text and error of files that are rows: path, kind (their extension) and content."""
    return files.select("path", "kind", "content").mapInPandas(_texts, "path string, text string, error string")


def images_of(files: DataFrame, side: int = 150) -> DataFrame:
    """path, number (from 0), width, height and image of the photos inside files that are rows.

    Other kinds, broken or locked files and unreadable images give none, nor
    do images with a side shorter than ``side``.
    """
    found = files.select("path", "kind", "content").mapInPandas(_images, "path string, number int, width int, height int, image binary")
    return found.where(large_enough(F.col("width"), F.col("height"), side))


PACKAGE = RELATIONSHIP[1 : RELATIONSHIP.index("}")]
IMAGE_TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"


def docx_file(lines: Column, photos: Column | None = None) -> Column:
    """A DOCX file with a paragraph for each line of an array, and a related image for each of ``photos``."""

    def made(paragraphs, images) -> bytes:
        body = "".join(f"<w:p><w:r><w:t>{escape(p or '')}</w:t></w:r></w:p>" for p in paragraphs)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
            if len(images):
                links = "".join(f'<Relationship Id="r{i}" Type="{IMAGE_TYPE}" Target="media/i{i}.png"/>' for i in range(len(images)))
                z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>')
                for i, image in enumerate(images):
                    z.writestr(f"word/media/i{i}.png", bytes(image))
        return out.getvalue()

    @F.pandas_udf("binary")
    def files(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paragraphs, images in batches:
            yield pd.Series([made(p, i) for p, i in zip(paragraphs, images)])

    return files(lines, photos if photos is not None else F.array().cast("array<binary>"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, kind, content in batch.itertuples(index=False):
            try:
                if kind not in READERS:
                    raise ValueError(f"Unsupported document type: .{kind}")
                rows.append((path, READERS[kind](content), None))
            except Exception as e:  # a broken file costs its own row only
                rows.append((path, None, str(e)))
        yield pd.DataFrame(rows, columns=["path", "text", "error"])


IMAGE_COLUMNS = ["path", "number", "width", "height", "image"]
IMAGE_BYTES = 4 << 20  # handed on at once


def _images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, held = [], 0
    for batch in batches:
        for path, kind, content in batch.itertuples(index=False):
            try:
                found = IMAGES[kind](content) if kind in IMAGES else []
            except Exception:  # photos are an addition to the text, which reports the error
                found = []
            rows += [(path, i, *size, x) for i, x in enumerate(found) if (size := image_size(x))]
            held += sum(map(len, found))
            # A frame costs far more than a file: many files share one, up to some bytes.
            if held >= IMAGE_BYTES or len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=IMAGE_COLUMNS)
                rows, held = [], 0
    yield pd.DataFrame(rows, columns=IMAGE_COLUMNS)


def large_enough(width, height, side: int = 150):
    return F.least(width, height) >= side
