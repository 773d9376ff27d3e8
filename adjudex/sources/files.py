"""Readers and writers of the engine's inputs and results."""

from __future__ import annotations

import io
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudex.functions.scalars import strip_html

#: Characters kept of a document.
DOCUMENT_CHARS = 25_000
BINARY_NOTE = "[binary file: no text]"


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def first_readable(*readers: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be read; the last one's error if none can."""
    for reader in readers[:-1]:
        try:
            return reader()
        except Exception:
            continue
    return readers[-1]()


def text_files(spark: SparkSession, path: str, limit: int | None = DOCUMENT_CHARS) -> DataFrame:
    """(path, text): whole files as UTF-8, a note for files that aren't, at most ``limit`` characters."""
    read = spark.read.format("binaryFile").load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(BINARY_NOTE))
    return read.select("path", (F.substring(text, 1, limit) if limit else text).alias("text"))


def notebook_text(raw: Column) -> Column:
    """Code and markdown cells of a notebook's JSON, joined; the raw text if it is none."""
    cells = F.try_variant_get(F.try_parse_json(raw), "$.cells", "array<struct<cell_type:string,source:variant>>")
    wanted = F.filter(cells, lambda c: c["cell_type"].isin("code", "markdown"))
    # A cell's source is a text or a list of lines.
    parts = F.transform(wanted, lambda c: F.coalesce(F.array_join(F.try_variant_get(c["source"], "$", "array<string>"), ""), F.try_variant_get(c["source"], "$", "string")))
    return F.coalesce(F.array_join(parts, "\n"), raw)


def _office_text(content: pd.Series, read: Callable[[bytes], str]) -> pd.Series:
    def one(data: bytes) -> str | None:
        try:
            return read(data)
        except Exception:
            return None

    return content.map(one)


def pdf_text(df: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Text of PDF files, page by page; needs ``pdfplumber`` on the executors, NULL for files that it can't read."""

    @F.pandas_udf(T.StringType())
    def run(data: pd.Series) -> pd.Series:
        import pdfplumber

        return _office_text(data, lambda b: "\n".join(p.extract_text() or "" for p in pdfplumber.open(io.BytesIO(b)).pages))

    return df.withColumn(out, run(content))


def docx_text(df: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Paragraphs of DOCX files; needs ``python-docx`` on the executors."""

    @F.pandas_udf(T.StringType())
    def run(data: pd.Series) -> pd.Series:
        import docx

        return _office_text(data, lambda b: "\n".join(p.text for p in docx.Document(io.BytesIO(b)).paragraphs))

    return df.withColumn(out, run(content))


def page_text(pages: DataFrame, html: str = "html", limit: int = 3000) -> DataFrame:
    return pages.withColumn("text", strip_html(F.col(html), limit))


def small_media(files: DataFrame, megabytes: int = 25) -> DataFrame:
    """Media files that a transcription service would take."""
    return files.filter(F.col("length") <= megabytes * 1024 * 1024)


def url_list(df: DataFrame, urls: str) -> DataFrame:
    """A row for each url of a comma-separated list."""
    return df.withColumn("url", F.explode(F.filter(F.transform(F.split(urls, ","), lambda u: F.trim(u)), lambda u: u != ""))).drop(urls)


def write_policies(rules: DataFrame, path: str) -> None:
    """Rules by policy; ids are checked first, as they name folders."""
    if not rules.filter(~F.col("policy_id").rlike(r"^[A-Za-z0-9_.\-]{1,64}$") | F.col("policy_id").isNull()).isEmpty():
        raise ValueError("a policy id has other characters than letters, digits, _ . -")
    rules.write.partitionBy("policy_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_policy(spark: SparkSession, path: str, policy_id: str) -> DataFrame:
    if not re.fullmatch(r"[A-Za-z0-9_.\-]{1,64}", policy_id):
        raise ValueError(f"bad policy id {policy_id}")
    return spark.read.parquet(path).filter(F.col("policy_id").cast("string") == policy_id)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.partitionBy("investigation_id").mode("overwrite").parquet(f"{path}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, as many as the result has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def ordinary(files: DataFrame, flag: str = "is_sensitive") -> DataFrame:
    """Without the files that are flagged as sensitive."""
    return files.filter(~F.coalesce(F.col(flag), F.lit(False)))


def cached_by_prompt(rows: DataFrame, system: str, user: str, answer: Callable[[str, str], str]) -> DataFrame:
    """Adds ``answer`` of an injected model function, called once for each distinct pair of prompts."""
    key = F.sha2(F.concat(F.col(system), F.lit("\0"), F.col(user)), 256)
    keyed = rows.withColumn("prompt_sha256", key)

    def run(batches):
        for b in batches:
            b["answer"] = [answer(s, u) for s, u in zip(b[system], b[user])]
            yield b[["prompt_sha256", "answer"]]

    once = keyed.select("prompt_sha256", system, user).dropDuplicates(["prompt_sha256"]).mapInPandas(run, "prompt_sha256 string, answer string")
    return keyed.join(once, "prompt_sha256", "left")
