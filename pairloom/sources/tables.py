"""Text tables, annotations, workbooks and arrays as DataFrames, and their sinks."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import durations, names, text
from ..storage import put

PATHS = "path_id int, path string"
FEATURES = "id long, energy_db double, wada_snr_db double, error string"
CODECS = ("zstd", "snappy", "gzip", "brotli", "none")
_XLSX = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """utterance, transcript and the id's fields of annotation lines; blank lines give no row."""
    lines = spark.read.text(path).select(text.split_annotation(F.col("value")).alias("line")).where("line is not null")
    return lines.select("line.utterance", "line.transcript", names.parse_utterance(F.col("line.utterance")).alias("p")).select("utterance", "transcript", "p.*")


def distant_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations for the distant microphone: ids rewritten, meetings known to be broken left out."""
    kept = annotations.where(~F.col("meeting_id").isin(*names.BROKEN_DISTANT_MEETINGS) | F.col("meeting_id").isNull())
    return kept.withColumns({"utterance": names.distant_utterance(F.col("utterance")), "microphone_id": F.lit("SDM1")})


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """file_name, folder, start_time and end_time of segment lines (parts between spaces)."""
    return spark.read.option("sep", " ").schema("file_name string, folder string, start_time double, end_time double").csv(path)


def segments_by_folder(segments: DataFrame) -> DataFrame:
    return segments.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_time") - F.col("start_time")).alias("seconds"), F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(PATHS).csv(path)


def read_trials_csv(spark: SparkSession, path: str) -> DataFrame:
    """enroll_path, test_path and duration_diff_cs; blank or unreadable differences are null."""
    rows = spark.read.option("header", True).schema("enroll_path string, test_path string, duration_diff string").csv(path)
    return rows.select("enroll_path", "test_path", durations.to_cs(F.col("duration_diff")).alias("duration_diff_cs"))


def read_trials(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Encoded trials; the sentinel of missing differences becomes null."""
    trials = spark.read.parquet(path)
    if "duration_diff_cs" in trials.columns:
        trials = trials.withColumn("duration_diff_cs", durations.from_sentinel(F.col("duration_diff_cs")))
    return trials.select(*columns) if columns else trials


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(FEATURES).csv(path)


def usable_features(features: DataFrame) -> DataFrame:
    return features.where("coalesce(error, '') = '' and energy_db is not null and wada_snr_db is not null")


def read_bins(spark: SparkSession, path: str, field: str = "equal_width_bins") -> DataFrame:
    """The bins of a JSON statistics file as rows: index, lower_seconds, upper_seconds, width_seconds, count."""
    kind = "struct<index: int, lower_seconds: double, upper_seconds: double, width_seconds: double, count: long>"
    found = spark.read.option("multiLine", True).schema(f"{field} struct<bins: array<{kind}>>").json(path)
    return found.select(F.inline(f"{field}.bins"))


def check_bins(bins: DataFrame, n: int) -> DataFrame:
    """bins if there are n of them, each starting where the one before ends; else an error."""
    rows = bins.orderBy("index").limit(n + 1).collect()
    if [r["index"] for r in rows] != list(range(n)) or any(abs(a["upper_seconds"] - b["lower_seconds"]) > 1e-6 for a, b in zip(rows, rows[1:])):
        raise ValueError(f"expected {n} adjoining bins, found {[(r['index'], r['lower_seconds'], r['upper_seconds']) for r in rows[:60]]}")
    return bins


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


# ---- workbooks


def sheet_rows(data: bytes, sheet: str) -> Iterator[list[str | None]]:
    """Rows of a sheet, as texts. The sheet's XML is read as a stream."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_XLSX}t")) for s in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot()]
        sheets = ElementTree.parse(book.open("xl/workbook.xml")).getroot().find(f"{_XLSX}sheets")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
        wanted = {s.get("name"): links[next(v for k, v in s.items() if k.endswith("}id"))] for s in sheets}
        if sheet not in wanted:
            raise ValueError(f"no sheet {sheet!r} among {sorted(wanted)}")
        for _, row in ElementTree.iterparse(book.open("xl/" + wanted[sheet].removeprefix("/xl/"))):
            if row.tag == f"{_XLSX}row":
                cells: list[str | None] = []
                for c in row:
                    letters = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    cells += [None] * (at - len(cells))
                    value = c.find(f"{_XLSX}v")
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_XLSX}t")))
                    else:
                        cells.append(shared[int(value.text)] if value is not None and c.get("t") == "s" else None if value is None else value.text)
                yield cells
                row.clear()


def read_sheet(spark: SparkSession, path: str, sheet: str, required: list[str] | None = None) -> DataFrame:
    """A sheet of an .xlsx file whose first row names the columns, all of them texts; columns without a
    name are left out. The file is read by a task, its sheet as a stream of rows."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame({"names": [next(sheet_rows(data, sheet), [])]})

    names_ = list(files.mapInPandas(head, "names array<string>").first()["names"])
    keep = [i for i, c in enumerate(names_) if c]

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = itertools.islice(sheet_rows(data, sheet), 1, None)
                for some in iter(lambda: list(itertools.islice(rows, 10_000)), []):
                    yield pd.DataFrame([[r[i] if i < len(r) else None for i in keep] for r in some], columns=[names_[i] for i in keep], dtype=object)

    out = files.mapInPandas(body, ", ".join("`" + names_[i].replace("`", "``") + "` string" for i in keep))
    return require_columns(out, required or [])


def write_workbook(spark: SparkSession, path: str, sheets: dict[str, DataFrame], summary: list[tuple[str, str]] | None = None, most: int = 1_048_575) -> None:
    """An .xlsx file with a sheet a DataFrame and, if given, a Summary sheet of (label, formula) rows.

    Workbooks are a report format, so at most `most` rows a sheet, which is the format's own limit; more
    are an error. Rows come to the driver a partition at a time. The first row is bold and stays in view."""

    def sheet(rows: Iterator[list]) -> str:
        def cell(v) -> str:
            if isinstance(v, str) and v.startswith("="):
                return f"<c><f>{escape(v[1:])}</f></c>"
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                return f"<c><v>{v}</v></c>"
            return "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

        first = "<row>" + "".join(cell(v).replace("<c", '<c s="1"', 1) for v in next(rows)) + "</row>"
        body = first + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
        view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_XLSX[1:-1]}">{view}<sheetData>{body}</sheetData></worksheet>'

    def rows_of(df: DataFrame) -> Iterator[list]:
        yield df.columns
        for n, r in enumerate(df.toLocalIterator()):
            if n >= most:
                raise ValueError(f"a sheet holds at most {most} rows")
            yield list(r)

    parts = {name: sheet(rows_of(df)) for name, df in sheets.items()}
    if summary:
        parts["Summary"] = sheet(iter([["metric", "value"], *[[a, b] for a, b in summary]]))
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(parts) + 1)) + "</Types>")
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_XLSX[1:-1]}" xmlns:r="{kinds}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(parts, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{kinds}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(parts) + 1)) + f'<Relationship Id="rIdS" Type="{kinds}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{_XLSX[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, body in enumerate(parts.values(), 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", body)
    put(spark, path, held.getvalue())


def summary_counts(sheet: str, columns: list[str], column: str, values: list[str]) -> list[tuple[str, str]]:
    """Summary rows of a sheet: its number of rows, and of rows with each value in a column, as formulas."""
    at = columns.index(column)
    letters = ""
    while at >= 0:
        letters, at = chr(65 + at % 26) + letters, at // 26 - 1
    counted = [(f"{sheet}: {column} = {v}", f'=COUNTIF({sheet}!{letters}:{letters},"{v}")') for v in values]
    return [(f"{sheet}: rows", f"=COUNTA({sheet}!A:A)-1"), *counted]


# ---- arrays


def read_npy(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """id and value (or vector, for two dimensions) of .npy files, the file mapped and read in ranges by
    the tasks; path must be readable on every executor."""
    shape = np.load(path, mmap_mode="r").shape
    kind = "id long, value double" if len(shape) == 1 else "id long, vector array<float>"

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = np.load(path, mmap_mode="r")
        for batch in batches:
            for start in batch["id"]:
                part = np.asarray(data[start * rows : (start + 1) * rows])
                ids = np.arange(start * rows, start * rows + len(part))
                yield pd.DataFrame({"id": ids, "value": part.astype(np.float64)} if part.ndim == 1 else {"id": ids, "vector": list(part.astype(np.float32))})

    return spark.range(-(-shape[0] // rows)).mapInPandas(load, kind)


def write_npy(df: DataFrame, path: str, key: str, value: str) -> int:
    """One .npy file (float32) with the value, or the vector, of each row in order of the key; the number
    of rows. The format is one file with one header, so the driver writes it, a partition at a time; path
    is the driver's. A null value is NaN."""
    rows = df.select(key, value).orderBy(key)
    n = rows.count()
    first = rows.first()
    shape = (n,) if first is None or not isinstance(first[1], list) else (n, len(first[1]))
    out = np.lib.format.open_memmap(path, "w+", np.float32, shape) if n else None
    for at, row in enumerate(rows.toLocalIterator()):
        out[at] = np.nan if row[1] is None else row[1]
    if out is None:
        np.save(path, np.zeros(0, np.float32))
    else:
        out.flush()
    return n


# ---- sinks


def write_table(df: DataFrame, path: str, codec: str = "zstd", row_group_bytes: int | None = None, mode: str = "errorifexists") -> None:
    """Parquet with a codec of CODECS; one that the session does not know falls back to snappy."""
    if codec not in CODECS:
        raise ValueError(f"codec {codec!r} is none of {CODECS}")
    writer = df.write.mode(mode)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    if codec == "brotli":
        try:
            df.sparkSession._jvm.java.lang.Class.forName("org.apache.hadoop.io.compress.BrotliCodec")
        except Exception:  # noqa: BLE001  the codec's jar is optional
            codec = "snappy"
    writer.option("compression", codec).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def json_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each row as a JSON text, column json."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("json"))


def markdown(title: str, df: DataFrame, most: int = 1000) -> str:
    """A report table of at most `most` rows; if there are more it says so."""
    rows = df.limit(most + 1).collect()
    more = [f"The first {most} rows of more."] if len(rows) > most else []
    rows = rows[:most]
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([f"## {title}", "", *lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows], *more, ""])


def convert(spark: SparkSession, source: str, source_format: str, target: str, target_format: str) -> None:
    """Copy a table between formats, losslessly."""
    spark.read.format(source_format).load(source).write.format(target_format).save(target)
