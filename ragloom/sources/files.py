"""File sources: dispatch by extension, section parsers with titles, web pages, golden-set JSON.

Parsers of bytes are Python functions from bytes to sections (content, section_type, level, page_number); any can be
replaced. Text files are parsed in native columns.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators.clients import Recogniser, first_of

#: Extensions by parser.
PARSERS = {"pdf": ["pdf"], "docx": ["docx", "doc"], "markdown": ["md", "markdown"], "plain": ["txt", "text"], "image": ["jpg", "jpeg", "png", "bmp", "tiff", "webp"]}
ROWS = "position int, content string, section_type string, level int, page_number int"
SectionRow = tuple[str, str, int, int | None]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def parser_of(path: Column) -> Column:
    out = F.lit("unsupported")
    for name, exts in PARSERS.items():
        out = F.when(extension(path).isin(*exts), F.lit(name)).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, content (bytes), file_hash, file_size, parser of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size"), parser_of(F.col("path")).alias("parser"))


def docx_sections(raw: bytes) -> list[SectionRow]:
    """One section per non-blank paragraph; 'Heading N' styles are headings of level N."""
    files = zipfile.ZipFile(io.BytesIO(raw))
    names: dict[str, str] = {}
    if "word/styles.xml" in files.namelist():
        for s in ElementTree.fromstring(files.read("word/styles.xml")).iter(f"{_W}style"):
            name = next((n.get(f"{_W}val") or "" for n in s.iter(f"{_W}name")), "")
            names[s.get(f"{_W}styleId") or ""] = name.replace("heading", "Heading")
    out: list[SectionRow] = []
    for p in ElementTree.fromstring(files.read("word/document.xml")).iter(f"{_W}p"):
        content = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = next((s.get(f"{_W}val") or "" for s in p.iter(f"{_W}pStyle")), "")
        level = re.fullmatch(r"Heading ?(\d+)", names.get(style, style))
        if content:
            out.append((content, "heading" if level else "text", int(level[1]) if level else 0, None))
    return out


_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|T\*|'|\"|T[dDmJj]|ET", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2)).decode("latin-1")

    def plain(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else _ESCAPES.get(c, b"" if c == b"\n" else c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S).decode("latin-1")


def _pdf_page(content: bytes) -> str:
    out, held = [], []
    for m in _SHOWN.finditer(content):
        token = m[0]
        if token[:1] in b"(<" and len(token) > 1:
            held.append(_pdf_string(token))
        elif token in (b"TJ", b"Tj", b"'", b'"'):
            out += (["\n"] if token in (b"'", b'"') else []) + held
            held = []
        else:  # a new line of text begins
            out.append("\n")
            held = []
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def simple_pdf_pages(raw: bytes) -> list[str]:
    """Text of the pages of a plain PDF: literal or hexadecimal strings in one-byte fonts, streams stored or deflated.

    Documents that need more (object streams, encryption, composite fonts) raise ValueError.
    """
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(raw)}
    if raw[:5] != b"%PDF-" or not objects or b"/Encrypt" in raw:
        raise ValueError("not a PDF that the built-in parser reads")
    pages = [(n, body) for n, body in objects.items() if re.search(rb"/Type\s*/Page\b", body)]
    if not pages:
        raise ValueError("no plain page objects")
    kids = [int(x) for body in objects.values() if re.search(rb"/Type\s*/Pages\b", body) for x in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/Kids\s*\[(.*?)\]", body, re.S) or [b"", b""])[1])]
    pages.sort(key=lambda p: kids.index(p[0]) if p[0] in kids else len(kids) + p[0])
    out = []
    for _, body in pages:
        found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        text = b""
        for n in re.findall(rb"(\d+)\s+\d+\s+R", found[1]) if found else []:
            part = objects.get(int(n), b"")
            if m := _STREAM.search(part):
                text += (zlib.decompress(m[1]) if b"/FlateDecode" in part[: m.start()] else m[1]) + b"\n"
        out.append(_pdf_page(text))
    return out


def pdf_sections(raw: bytes) -> list[SectionRow]:
    """One section per non-blank page, by PyMuPDF where it is installed, else by the built-in parser."""
    try:
        import fitz
    except ImportError:
        pages = simple_pdf_pages(raw)
    else:
        with fitz.open(stream=raw, filetype="pdf") as doc:
            pages = [page.get_text() for page in doc]
    return [(t.strip(), "text", 0, i + 1) for i, t in enumerate(pages) if t.strip()]


def image_sections(*chain: Recogniser) -> Callable[[bytes], list[SectionRow]]:
    """One section per non-blank line of the text of the first recogniser that answers; without one no text is found."""

    def parse(raw: bytes) -> list[SectionRow]:
        found = first_of(*(lambda c=c: c.recognise(raw) for c in chain)) or ""
        return [(line.strip(), "text", 0, None) for line in found.split("\n") if line.strip()]

    return parse


def parse_binary(files: DataFrame, parsers: dict[str, Callable[[bytes], list[SectionRow]]] | None = None) -> DataFrame:
    """path and sections of files whose parser needs bytes (docx, pdf, image); a file that can't be parsed raises."""
    known = {"docx": docx_sections, "pdf": pdf_sections, "image": image_sections()} | (parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, *s) for p, raw, kind in zip(pdf["path"], pdf["content"], pdf["parser"], strict=True) for i, s in enumerate(known[kind](raw))]
            yield pd.DataFrame(rows, columns=["path", "position", "content", "section_type", "level", "page_number"]).astype({"page_number": "Int32"})

    return files.filter(F.col("parser").isin(*known)).select("path", "content", "parser").mapInPandas(run, f"path string, {ROWS}")


def text_sections(text: Column, parser: Column) -> Column:
    plain = F.transform(T.plain_sections(text), lambda x: T.text_section(x))
    return F.when(parser == "markdown", T.markdown_sections(text)).otherwise(plain)


def parse_text(files: DataFrame) -> DataFrame:
    """path and sections of Markdown and plain files, in native columns."""
    sections = text_sections(F.decode("content", "UTF-8"), F.col("parser"))
    rows = files.filter(F.col("parser").isin("markdown", "plain")).select("path", F.posexplode(sections).alias("position", "s"))
    return rows.select("path", "position", "s.content", "s.section_type", "s.level", "s.page_number")


def parse_files(files: DataFrame, parsers: dict[str, Callable[[bytes], list[SectionRow]]] | None = None) -> DataFrame:
    """path and sections of all files; an extension without a parser raises when its row is reached."""
    known = F.when(F.col("parser") == "unsupported", F.raise_error(F.concat(F.lit("unsupported file: "), F.col("path")))).otherwise(F.col("parser"))
    checked = files.withColumn("parser", known.cast("string"))
    return parse_text(checked).unionByName(parse_binary(checked, parsers))


def titles(files: DataFrame, sections: DataFrame) -> DataFrame:
    """path, title, page_count: a leading heading (Markdown without its marks, Word to 100 characters), a PDF's first line,
    else the file's name."""
    first = sections.filter("position = 0").select("path", "content", "section_type")
    pages = sections.groupBy("path").agg(F.max("page_number").alias("page_count"))
    rows = files.select("path", "name", "parser").join(first, "path", "left").join(pages, "path", "left")
    heading = F.col("section_type") == "heading"
    line = F.left(F.split("content", "\n")[0], F.lit(100))
    title = (
        F.when((F.col("parser") == "markdown") & heading, T.strip(F.regexp_replace("content", "^[# ]+", "")))
        .when((F.col("parser") == "docx") & heading, F.left("content", F.lit(100)))
        .when((F.col("parser") == "pdf") & (line != ""), line)
    )
    return rows.select("path", F.coalesce(title, "name").alias("title"), "page_count")


def scrape(urls: DataFrame, fetch: Callable[[str], str], render: Callable[[str], str], least: int = 500) -> DataFrame:
    """url, title, content, raw_html, how: the fetched page if it holds over ``least`` characters, else the rendered one,
    else the thin one; error where both clients failed."""

    def load(client: Callable[[str], str]):
        @F.pandas_udf("string")
        def pages(rows: pd.Series) -> pd.Series:
            return rows.map(lambda u: first_of(lambda: client(u)), na_action="ignore")

        return pages

    got = urls.select("url", load(fetch)(F.col("url")).alias("html")).withColumn("content", T.html_text(F.col("html")))
    thick = F.coalesce(F.length("content") > least, F.lit(False))
    both = got.withColumn("rendered", load(render)(F.when(~thick, F.col("url")))).withColumn("better", T.html_text(F.col("rendered")))
    how = F.when(thick, "fetched").when(F.col("rendered").isNotNull(), "rendered").when(F.col("html").isNotNull(), "thin").otherwise("error")
    html = F.when(how == "rendered", F.col("rendered")).otherwise(F.col("html"))
    content = F.when(how == "rendered", F.col("better")).otherwise(F.col("content"))
    return both.select("url", T.html_title(html).alias("title"), content.alias("content"), html.alias("raw_html"), how.alias("how"))


def imported(pages: DataFrame) -> DataFrame:
    """The documents of scraped pages with text: the text is what is stored, hashed and measured."""
    rows = pages.filter(T.strip(F.col("content")) != "")
    return rows.select(
        F.left("title", F.lit(500)).alias("title"), F.left("url", F.lit(2000)).alias("source_url"), "content", F.sha2("content", 256).alias("content_hash"),
        F.octet_length("content").alias("file_size"), F.lit("text/markdown").alias("mime_type"), F.lit("web").alias("source_type"), F.lit("pending").alias("processing_status"),
    )


GOLDEN = "query string, relevant_chunk_ids array<string>, user_id string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """The golden set; a missing file is an empty one."""
    try:
        return spark.read.schema(GOLDEN).json(path, multiLine=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], GOLDEN)


def save_golden(samples: DataFrame, path: str) -> None:
    """Each partition becomes a file with one JSON array, as ``read_golden`` takes them."""

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = [line for pdf in batches for line in pdf["line"]]
        if lines:
            yield pd.DataFrame({"value": ["[" + ",".join(lines) + "]"]})

    samples.select(F.to_json(F.struct("query", "relevant_chunk_ids", "user_id")).alias("line")).mapInPandas(arrays, "value string").write.mode("overwrite").text(path)


def append_golden(spark: SparkSession, old: str, new: str, samples: DataFrame) -> None:
    """Writes the golden set with more samples to a new place."""
    save_golden(read_golden(spark, old).unionByName(samples), new)
