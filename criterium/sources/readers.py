"""Sources: records in JSON lines and documents, CSV, notes and worksheets, text inside pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, tolerant: bool = False) -> DataFrame:
    """One record a line. A missing file is an empty relation; a corrupt line is an error, or left out if ``tolerant``."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A document, or an array of them, over many lines; none if it cannot be read."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def json_any(spark: SparkSession, path: str, schema: T.StructType | str, limit: int | None = None) -> DataFrame:
    """A JSON array or JSON lines, by the first character that is not white space."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(head) and head[0]["value"].lstrip().startswith("[")
    df = json_document(spark, path, schema) if array else json_lines(spark, path, schema)
    return df.limit(limit) if limit is not None else df


def csv_files(spark: SparkSession, path: str, key: str, pattern: str) -> DataFrame:
    """CSV files with a key taken from each file's name."""
    return spark.read.csv(path, header=True, inferSchema=True).withColumn(key, F.regexp_extract(F.input_file_name(), pattern, 1))


def partitioned(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records under ``judge=/model=`` folders; filters on those read just their folders."""
    return spark.read.schema(schema).option("basePath", path).json(path)


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text, stripped, without blanks and # lines; none if the file is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "note string")
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("note")).where((F.col("note") != "") & ~F.col("note").startswith("#"))


def worksheet(text: Column, head: str = r"(?m)^#+ *row +(\d+)", label: str = r"(?m)^human_label:[ \t]*(\S*)") -> Column:
    """Blocks of a worksheet as an array of (row, label): headings, and the last label of each block."""
    blocks = F.slice(F.split(F.regexp_replace(text, head, "\u0001$1\u0002"), "\u0001"), 2, 100_000)
    one = lambda b: F.struct(
        F.substring_index(b, "\u0002", 1).cast("int").alias("row"), F.try_element_at(F.regexp_extract_all(b, F.lit(label), F.lit(1)), F.lit(-1)).alias("label")
    )
    return F.transform(blocks, one)


def setting(text: Column, pattern: str, default: str) -> Column:
    """A value scraped from prose, or the default."""
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(default))


def script_bodies(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise AnalysisException(f"missing columns: {', '.join(missing)}")
    return df


def spreadsheet(spark: SparkSession, path: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """A sheet of prompts, read once on the driver (needs openpyxl); required columns must be there."""
    import pandas as pd

    frame = pd.read_excel(path, nrows=limit)
    return require_columns(spark.createDataFrame(frame.astype(object).where(frame.notna(), None).astype(str)), columns)


def checked_labels(rows: DataFrame, required: list[str], verdict: str = "human") -> DataFrame:
    """Human labels: required columns, and verdicts PASS, FAIL or blank; another one is an error when read."""
    ok = F.upper(F.trim(F.coalesce(verdict, F.lit("")))).isin("PASS", "FAIL", "")
    return require_columns(rows, required).withColumn(verdict, F.when(ok, F.col(verdict)).otherwise(F.raise_error(F.concat(F.lit("bad verdict: "), F.col(verdict)))))


class ModelSource:
    """What a live source of answers or verdicts must offer; :func:`pull_rows` runs it over pending rows.

    ``ask(prompt) -> (text, stop_reason)``. Networks are out of scope here: tests use a fake.
    """

    def ask(self, prompt: str) -> tuple[str, str]:
        raise NotImplementedError


def pull_rows(pending: DataFrame, source: ModelSource, key: str = "id", prompt: str = "prompt") -> DataFrame:
    """Ask the source for every pending row: key, response, finish_reason."""

    def run(frames):
        import pandas as pd

        for f in frames:
            answers = [source.ask(p) for p in f["prompt"]]
            yield pd.DataFrame({"id": f["id"], "response": [a for a, _ in answers], "finish_reason": [s for _, s in answers]})

    return pending.select(F.col(key).cast("string").alias("id"), F.col(prompt).alias("prompt")).mapInPandas(run, "id string, response string, finish_reason string")
