"""Rows, paragraphs and retrieved items as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import strip


def rendered(columns: dict[str, Column]) -> Column:
    """`Header: value` lines of the values that are not null."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in columns.items()]
    return F.concat_ws("\n", *lines)


def row_sources(df: DataFrame, sheet: str, row: Column, columns: dict[str, Column], corpus: Column | None = None, source_type: str = "table_row") -> DataFrame:
    """A source for each row with a value; row is its number in the sheet, from 1."""
    prefix = sheet.replace(" ", "_")
    out = df.select(
        (corpus if corpus is not None else F.lit(sheet)).alias("corpus_id"),
        row.cast("long").alias("source_ord"),
        F.concat(F.lit(f"{prefix}_row_"), row.cast("string")).alias("source_id"),
        rendered(columns).alias("content"),
        F.lit(source_type).alias("source_type"),
    )
    return out.where(F.col("content") != "")


def financial_rows(df: DataFrame, sheet: str, row: Column, columns: dict[str, Column], corpus: Column | None = None) -> DataFrame:
    return row_sources(df, sheet, row, columns, corpus, "financial_table_row")


def sections(paragraphs: DataFrame, source_type: str = "section") -> DataFrame:
    """Paragraphs (doc_id, ord, style, text) to sections that begin at headings; empty ones are not numbered."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    marked = paragraphs.withColumn("part", F.sum(F.col("style").startswith("Heading").cast("int")).over(order))
    lines = F.array_sort(F.collect_list(F.when(strip(F.col("text")) != "", F.struct("ord", strip(F.col("text")).alias("text")))))
    joined = marked.groupBy("doc_id", "part").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("content")).where("content <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return joined.select("doc_id", number.cast("long").alias("source_ord"), F.concat(F.lit("section_"), number).alias("source_id"), "content", F.lit(source_type).alias("source_type"))


def paragraph_sources(paragraphs: DataFrame, source_type: str = "paragraph") -> DataFrame:
    """A source for each paragraph with text; numbers count the empty ones too. ord starts at 0."""
    return paragraphs.select("doc_id", F.col("ord").cast("long").alias("source_ord"), F.concat(F.lit("para_"), F.col("ord")).alias("source_id"), strip(F.col("text")).alias("content"), F.lit(source_type).alias("source_type")).where("content <> ''")


def legal_sections(paragraphs: DataFrame) -> DataFrame:
    """Sections as clauses, those that say what a quoted term means as definitions."""
    told = F.col("content").contains('"') & F.col("content").contains(" means ")
    return sections(paragraphs).withColumn("source_type", F.when(told, "legal_definition").otherwise("legal_clause"))


def retrieved_sources(items: DataFrame, content: str, metadata: str, position: str) -> DataFrame:
    """Retrieved items as sources named by their metadata's source, else by position."""
    return items.withColumns({"source_id": F.coalesce(F.col(metadata)["source"], F.concat(F.lit("source_"), F.col(position).cast("string"))), "content": F.col(content)})


_WORDS_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _paragraphs(content: bytes) -> list[tuple[str, str]]:
    """Style names and texts of a .docx file's paragraphs, in order; Normal where none is named."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = _WORDS_NS
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{w}style"):
                named = style.find(f"{w}name")
                if named is not None:
                    names[style.get(f"{w}styleId")] = named.get(f"{w}val")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    out = []
    for p in body.findall(f"{w}p") if body is not None else []:
        told = p.find(f"{w}pPr/{w}pStyle")
        key = told.get(f"{w}val") if told is not None else "Normal"
        name = names.get(key, key)
        pieces = [{f"{w}t": t.text or "", f"{w}tab": "\t", f"{w}br": "\n"}.get(t.tag, "") for t in p.iter()]
        out.append((name[:1].upper() + name[1:], "".join(pieces)))
    return out


def _sheets(content: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """Names and rows of an .xlsx file's sheets; cells as text, empty ones null."""
    import io
    import posixpath
    import re
    import zipfile
    from xml.etree import ElementTree

    m = _SHEET_NS
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{m}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        have = set(z.namelist())
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{m}si")] if "xl/sharedStrings.xml" in have else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"):
            at = targets[sheet.get(f"{_REL_NS}id")]
            root = ElementTree.fromstring(z.read(at.lstrip("/") if at.startswith("/") else posixpath.normpath(f"xl/{at}")))
            rows: list[list[str | None]] = []
            for row in root.iter(f"{m}row"):
                number = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(number - 1 - len(rows))]
                cells: list[str | None] = []
                for cell in row.findall(f"{m}c"):
                    letters = re.match("[A-Z]*", cell.get("r") or "")[0]
                    column = 0
                    for ch in letters:
                        column = 26 * column + ord(ch) - 64
                    cells += [None] * (column - 1 - len(cells))
                    value, kind = cell.find(f"{m}v"), cell.get("t")
                    said = None if value is None else value.text
                    if kind == "s" and said is not None:
                        said = shared[int(said)]
                    elif kind == "b" and said is not None:
                        said = "True" if said == "1" else "False"
                    elif kind == "inlineStr":
                        said = text(cell)
                    cells.append(said)
                rows.append(cells)
            out.append((sheet.get("name"), rows))
    return out


def docx_paragraphs(spark, path: str) -> DataFrame:
    """doc_id (the path), ord, style, text of the paragraphs of .docx files, as sections and paragraph_sources want them."""
    import pandas as pd

    def read(batches):
        for pdf in batches:
            rows = [(p, i, style, t) for p, content in zip(pdf["path"], pdf["content"], strict=True) for i, (style, t) in enumerate(_paragraphs(content))]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "style", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "doc_id string, ord int, style string, text string")


def xlsx_rows(spark, path: str, source_type: str = "table_row") -> DataFrame:
    """A source for each row with a value in .xlsx files: the first row names the columns (`col_0` where it is empty)."""
    import pandas as pd

    def read(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                place = 0
                for name, rows in _sheets(content):
                    heads = [h if h is not None else f"col_{i}" for i, h in enumerate(rows[0])] if rows else []
                    for n, row in enumerate(rows[1:], start=1):
                        lines = [f"{h}: {v}" for h, v in zip(heads, row, strict=False) if v is not None]
                        if lines:
                            out.append((p, place, f"{name.replace(' ', '_')}_row_{n}", "\n".join(lines), source_type))
                            place += 1
            yield pd.DataFrame(out, columns=["corpus_id", "source_ord", "source_id", "content", "source_type"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "corpus_id string, source_ord long, source_id string, content string, source_type string")


def document_texts(spark, path: str, kind: str) -> DataFrame:
    """path and text of binary documents (pdf: pages, docx: paragraphs, joined by line feeds).

    pdf needs the optional package pypdf on the executors.
    """
    import io

    import pandas as pd

    def read(batches):
        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                if kind == "pdf":
                    from pypdf import PdfReader

                    texts.append("\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages))
                else:
                    texts.append("\n".join(t for _, t in _paragraphs(content)))
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string")
