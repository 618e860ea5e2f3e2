"""Readers for files other than Parquet."""

from __future__ import annotations

import ast
import csv
import io
import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import carry_forward

#: Tried in this order; the last resort replaces what it cannot read.
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb18030")


def read_csv(spark: SparkSession, path: str | Sequence[str], separator: str = ",") -> DataFrame:
    """A CSV with header, doubled quotes and line breaks within fields; a byte-order mark is taken away; all columns STRING."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", separator)
    r = r.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    df = r.csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_csv_any_encoding(spark: SparkSession, path: str, columns: Sequence[str], encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """Rows of CSV files of which each may have another encoding: the first one that decodes the whole file counts.

    A file is one task's unit, as its encoding is a property of the whole file. Missing columns are null.
    """

    def decode(data: bytes) -> str:
        for e in encodings:
            try:
                return data.decode(e)
            except UnicodeDecodeError:
                continue
        return data.decode("utf-8", "replace")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                rows = [[r.get(c) for c in columns] + [name] for r in csv.DictReader(io.StringIO(decode(data), newline=""))]
                yield pd.DataFrame(rows, columns=[*columns, "__file"])

    schema = ", ".join(f"`{c}` string" for c in [*columns, "__file"])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_tsv_tree(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """All tab-separated files below a folder whose name fits, with their file; unreadable files are skipped."""
    df = spark.read.option("header", True).option("sep", "\t").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).csv(root)
    return df.withColumn("file", F.col("_metadata.file_path"))


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """One sheet of a workbook, read on the driver (a workbook holds at most 2^20 rows); needs an Excel package of pandas."""
    try:
        pdf = pd.read_excel(path, sheet_name=sheet, dtype=str)
    except ImportError as e:
        raise ImportError("reading workbooks needs openpyxl or another engine of pandas") from e
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"`{c}` string" for c in pdf.columns))


def read_table_file(spark: SparkSession, path: str) -> DataFrame:
    """A workbook or a CSV, by the file's ending."""
    return read_excel(spark, path) if path.lower().endswith((".xlsx", ".xls")) else read_csv(spark, path)


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are skipped; malformed ones fail the query, or are dropped if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def labelled(df: DataFrame, path: str, out: str, default: str) -> DataFrame:
    """A nested label as a column, a default where it is absent."""
    return df.withColumn(out, F.coalesce(F.col(path), F.lit(default)))


def read_class_tree(spark: SparkSession, path: str, child: str = "C4_", parent: str = "C3_") -> DataFrame:
    """term, parent of the classes of an OWL file whose id and whose parent's id begin with the given prefixes."""
    x = spark.read.format("xml").option("rowTag", "owl:Class").option("attributePrefix", "_").load(path)
    up = F.col("`rdfs:subClassOf`.`_rdf:resource`")
    rows = x.select(F.col("`_rdf:ID`").alias("id"), F.regexp_replace(up, "^#", "").alias("up"))
    return rows.where(F.col("id").startswith(child) & F.col("up").startswith(parent)).select(F.substring("id", len(child) + 1, 1000).alias("term"), F.substring("up", len(parent) + 1, 1000).alias("parent"))


# --- line-oriented texts


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, i, line of texts; i counts from 0."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("i", "line"))


def text_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, i, line of whole text files; a file is read as one text so that its lines keep their order."""
    t = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return numbered_lines(t, "file", "value")


def under_headings(lines: DataFrame, key: str, headings: dict[str, str]) -> DataFrame:
    """Lines that are no headings and not blank, each with the last heading of every kind above it in its text.

    headings: column -> pattern whose first group is the heading.
    """
    order = [F.asc("i")]
    out, is_heading = lines, F.lit(False)
    for name, pattern in headings.items():
        hit = F.col("line").rlike(pattern)
        out = out.withColumn(name, carry_forward(F.when(hit, F.regexp_extract("line", pattern, 1)), [key], order))
        is_heading = is_heading | hit
    return out.where(~is_heading & (F.trim("line") != ""))


def records(lines: DataFrame, key: str, start: str, comment: str) -> DataFrame:
    """key, n, title, body, comment: a line that fits `start` begins a record, lines that fit `comment` are its comment, others its body."""
    n = F.sum(F.when(F.col("line").rlike(start), 1).otherwise(0)).over(_upto(key))
    x = lines.withColumn("n", n).where("n > 0")
    title = F.max(F.when(F.col("line").rlike(start), F.regexp_extract("line", start, 1)))
    pick = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("i", "line")))), lambda v: v["line"]), "\n")
    is_comment, is_start = F.col("line").rlike(comment), F.col("line").rlike(start)
    return x.where("trim(line) <> ''").groupBy(key, "n").agg(title.alias("title"), pick(~is_comment & ~is_start).alias("body"), pick(is_comment & ~is_start).alias("comment"))


def _upto(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)


def catalog_entries(lines: DataFrame, key: str, headings: dict[str, str]) -> DataFrame:
    """The words of catalogue lines with their headings, each combination once."""
    x = under_headings(lines, key, headings)
    return x.select(*headings, F.explode(F.filter(F.split(F.trim("line"), r"[\s　]+"), lambda w: w != "")).alias("entry")).dropDuplicates([*headings, "entry"])


def phrase_headings(lines: DataFrame, key: str, heading: str) -> DataFrame:
    """phrase, heading: phrases of two to five ideographs under their first heading, in the order of keys and lines."""
    x = under_headings(lines, key, {"heading": heading})
    p = x.select(key, "i", "heading", F.explode(F.regexp_extract_all("line", F.lit("([一-鿿]{2,5})"), F.lit(1))).alias("phrase")).where("heading is not null")
    return p.groupBy("phrase").agg(F.min_by("heading", F.struct(key, "i")).alias("heading"))


# --- configuration and word lists, which are small by nature


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON document without the keys that begin with an underscore."""
    files = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(files) != 1:
        raise ValueError(f"one document is expected at {path}")
    text = files[0].value
    return {k: v for k, v in json.loads(text).items() if not k.startswith("_")}


def read_literal(path: str) -> dict:
    """A Python literal in a file; nothing is executed."""
    with open(path, encoding="utf-8") as f:
        return ast.literal_eval(f.read())


def script_vocabulary(spark: SparkSession, path: str, name: str) -> DataFrame:
    """category, term: a vocabulary that a Python script assigns to a name, as a literal dict of lists or a list (category null).

    The script is parsed, never executed; a value that is no literal is an error.
    """
    files = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(files) != 1:
        raise ValueError(f"one script is expected at {path}")
    for node in ast.parse(files[0].value).body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        if node_value := (getattr(node, "value", None) if any(isinstance(t, ast.Name) and t.id == name for t in targets) else None):
            value = ast.literal_eval(node_value)
            rows = [(c, t) for c, ts in value.items() for t in ts] if isinstance(value, dict) else [(None, t) for t in value]
            return spark.createDataFrame(rows, "category string, term string")
    raise ValueError(f"{path} does not assign {name}")


def read_words(spark: SparkSession, path: str, inline: Sequence[str] = (), comments: bool = False) -> DataFrame:
    """word: the lines of a word list and some given words, each once; lines after # are words only if comments is set."""
    w = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")
    if not comments:
        w = w.where(~F.col("word").startswith("#"))
    return w.union(spark.createDataFrame([(x,) for x in inline], "word string")).distinct()


def lexicon_table(spark: SparkSession, lexicon: dict[str, dict[str, float]] | dict[str, Sequence[str]]) -> DataFrame:
    """term, category, weight of a word list by categories; of a term in several categories the first one counts."""
    seen: dict[str, tuple[str, float]] = {}
    for category, terms in lexicon.items():
        for t in terms:
            seen.setdefault(t, (category, float(terms[t]) if isinstance(terms, dict) else 1.0))
    return spark.createDataFrame([(t, c, w) for t, (c, w) in seen.items()], "term string, category string, weight double")


# --- pages and addresses


# Where shop addresses carry their keys.
URL_KEYS = (r"/SalePageCategory/(\d+)", r"/page/(\d+)", r"/SalePage/Index/(\d+)")


def url_key(url: Column, patterns: Sequence[str] = URL_KEYS, default: str = "unknown") -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns], F.lit(default))


def label_value(html: Column, label: str) -> Column:
    """What follows `label:` up to the next tag or line end, null if the label is absent."""
    text = F.regexp_replace(html, r"<br\s*/?>", "\n")
    return F.nullif(F.trim(F.regexp_extract(text, rf"{label}\s*[:：]\s*(?:<[^>]+>\s*)*([^<\n]+)", 1)), F.lit(""))


def links(html: Column, pattern: str) -> Column:
    """The different link targets that fit a pattern, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf'href="([^"]*{pattern}[^"]*)"'), F.lit(1)))


# --- remote and stored models


def ask(df: DataFrame, key: str, prompt: str, clients: Sequence[Callable[[list[str]], list[str]]], batch: int = 100, retries: int = 3) -> DataFrame:
    """key, answer, provider: prompts sent in batches to the first client that answers; null answers if none does.

    Clients are functions that the caller brings along; they run on executors and must be picklable.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), batch):
                part = b.iloc[a : a + batch]
                answers, provider = [None] * len(part), None
                for i, client in enumerate(clients):
                    for _ in range(retries):
                        try:
                            answers, provider = client(part["p"].tolist()), i
                            break
                        except Exception:  # noqa: BLE001 - the next try or client follows
                            continue
                    if provider is not None:
                        break
                yield pd.DataFrame({key: part["k"], "answer": answers, "provider": pd.array([provider] * len(part), dtype="Int32")})

    return df.select(F.col(key).alias("k"), F.col(prompt).alias("p")).mapInPandas(run, f"{key} {kind}, answer string, provider int")


def newest_checkpoint(names: Iterable[str]) -> str | None:
    """Of the names in a model folder: '' (the folder itself) if it holds a configuration, else checkpoint-N of greatest N."""
    names = list(names)
    if "config.json" in names:
        return ""
    numbered = [(int(n.split("-")[1]), n) for n in names if n.startswith("checkpoint-") and n.split("-")[1].isdigit()]
    return max(numbered)[1] if numbered else None
