"""Normalisation of inputs to Markdown, with a report per file: what came in, what was used, and why it failed.

Markdown passes, plain text is trimmed, .docx is read here (paragraphs,
headings, lists and tables of its XML), .doc needs a converter.  A converter is
any function of (bytes, suffix) that gives Markdown; by default the one on the
machines' path, if there is one.  Nothing fails as a whole: a file that can't be
read is a row with its error.  Results stay in the table; an intermediate copy
is written only if asked for.
"""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .. import config
from .files import decoded, suffix

TYPES = (".md", ".txt", ".docx", ".doc")
CONVERTER = "pandoc"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_OUT = StructType([StructField("text", StringType()), StructField("converter", StringType()), StructField("available", BooleanType()), StructField("error", StringType())])


def _said(node: ElementTree.Element) -> str:
    return "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in node.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))


def _paragraph(p: ElementTree.Element) -> str:
    style = p.find(f"{_W}pPr/{_W}pStyle")
    name = (style.get(f"{_W}val") or "" if style is not None else "").lower()
    level = next((int(c) for c in name if c.isdigit()), 1) if "heading" in name or name.isdigit() else 1 if name == "title" else 0
    if level:
        return "#" * min(level, 6) + " " + _said(p)
    return ("- " if p.find(f"{_W}pPr/{_W}numPr") is not None else "") + _said(p)


def _table(t: ElementTree.Element) -> str:
    rows = [[" ".join(_said(c).split()) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([*lines[:1], *(["|" + "---|" * len(rows[0])] if rows else []), *lines[1:]])


def docx_markdown(raw: bytes) -> str:
    """Markdown of a .docx file."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    parts = [_table(x) if x.tag == f"{_W}tbl" else _paragraph(x) for x in (body if body is not None else ()) if x.tag in (f"{_W}p", f"{_W}tbl")]
    return "\n\n".join(p for p in parts if p.strip()) + "\n"


def converter_path() -> str | None:
    return shutil.which(CONVERTER)


def by_command(raw: bytes, kind: str) -> str:
    """Markdown by the converter on the path."""
    command = converter_path()
    if command is None:
        raise FileNotFoundError(f"{CONVERTER} is not on the path; install it or convert the file to .docx or .md first")
    with tempfile.TemporaryDirectory() as d:
        source = os.path.join(d, f"in{kind}")
        with open(source, "wb") as f:
            f.write(raw)
        done = subprocess.run([command, source, "-t", "gfm"], capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError((done.stderr or done.stdout or f"{CONVERTER} failed").strip())
    return done.stdout


def _one(raw: bytes, kind: str, convert: Callable[[bytes, str], str]) -> tuple:
    available = None
    try:
        if kind == ".docx":
            return docx_markdown(raw), "docx_reader", None, None
        available = convert is not by_command or converter_path() is not None
        return convert(raw, kind), CONVERTER if convert is by_command else "injected", available, None
    except FileNotFoundError as e:
        return None, CONVERTER, False, f"normalisation failed for {kind}: {e}"
    except Exception as e:  # whatever a broken file or a converter does is the row's error
        hint = "; .doc is experimental, convert it to .docx first" if kind == ".doc" else ""
        return None, "docx_reader" if kind == ".docx" else CONVERTER, available, f"normalisation failed for {kind}: {e}{hint}"


def converted(content: Column, kind: Column, convert: Callable[[bytes, str], str] = by_command) -> Column:
    @F.pandas_udf(_OUT)
    def run(raw: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_one(bytes(r), k, convert) for r, k in zip(raw, kinds, strict=True)], columns=["text", "converter", "available", "error"])

    return run(content, kind)


def normalise(files: DataFrame, convert: Callable[[bytes, str], str] = by_command, keep: str | None = None) -> DataFrame:
    """binaryFile rows -> (path, text, report). keep: a folder for intermediate copies, by the file's name.

    report: original_path, original_type, normalized_path, normalized_type,
    converter_used, converter_available, external_used, success, error,
    keep_intermediate, temporary.
    """
    kind = suffix(F.col("path"))
    early = F.when(~kind.isin(*TYPES), F.concat(F.lit("unsupported file type "), kind)).when(F.col("length") > config.MAX_FILE_BYTES, "file is too large")
    df = files.select("path", kind.alias("kind"), early.alias("early"), "content")
    office = F.col("kind").isin(".docx", ".doc") & F.col("early").isNull()
    nothing = F.lit(b"").cast("binary")
    df = df.withColumns({
        "_r": decoded(F.when(~F.col("kind").isin(".docx", ".doc") & F.col("early").isNull(), F.col("content")).otherwise(nothing)),
        "_c": F.when(office, converted(F.when(office, F.col("content")).otherwise(nothing), F.when(office, F.col("kind")).otherwise(".docx"), convert)),
    })
    trimmed = F.regexp_replace("_r.text", r"(?U)^\s+|\s+$", "")
    plain = F.when(F.col("kind") == ".txt", F.when(trimmed == "", "").otherwise(F.concat(trimmed, F.lit("\n")))).otherwise(F.col("_r.text"))
    error = F.coalesce("early", F.when(office, F.col("_c.error")), F.when(~office & F.col("_r.encoding").isNull(), "undecodable"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    kept = F.when(F.col("kind") == ".md", F.col("path")).when(error.isNull() & F.lit(keep is not None), F.concat(F.lit((keep or "").rstrip("/") + "/"), stem, F.lit(".normalized.md")))
    report = F.struct(
        F.col("path").alias("original_path"), F.col("kind").alias("original_type"), kept.alias("normalized_path"), F.lit(".md").alias("normalized_type"),
        F.when(F.col("early").isNotNull() | (F.col("kind") == ".md"), "none").when(office, F.col("_c.converter")).otherwise("plain_text").alias("converter_used"), F.col("_c.available").alias("converter_available"),
        (F.coalesce(F.col("_c.converter"), F.lit("")).isin(CONVERTER, "injected") & error.isNull()).alias("external_used"), error.isNull().alias("success"), error.alias("error"), F.lit(keep is not None).alias("keep_intermediate"),
        F.lit(False).alias("temporary"),
    )
    return df.select("path", F.when(error.isNull(), F.when(office, F.col("_c.text")).otherwise(plain)).alias("text"), report.alias("report"))


def read_inputs(spark: SparkSession, path: str, convert: Callable[[bytes, str], str] = by_command) -> DataFrame:
    """All inputs below a folder, normalised."""
    return normalise(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt,docx,doc}").load(path), convert)


def write_texts(df: DataFrame, folder: str, name: str = "name", text: str = "text") -> None:
    """One file per document, in a folder of the document's name: the bytes of its text and nothing else."""
    df.select(F.regexp_replace(name, "[^\\w.\\-]", "_").alias("name"), F.col(text).alias("value")).write.mode("overwrite").option("lineSep", "\u0000").partitionBy("name").text(folder)
