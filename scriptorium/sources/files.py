"""Reading and writing: text volumes, whole books, EPUB, JSON families, CSV and text exports, append with resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_volumes(spark: SparkSession, folder: str, charset: str = "GB18030") -> DataFrame:
    """volume_no, line, text of the files <digits>.txt below a folder, one file at a time in the workers."""
    import pyarrow as pa

    def decoded(batches):
        for batch in batches:
            texts = [content.as_py().decode(charset, "replace") for content in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["stem", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    stem = F.regexp_extract("path", r"/(\d+)\.txt$", 1)
    named = files.select(stem.alias("stem"), "content").where("stem <> ''").mapInArrow(decoded, "stem string, text string")
    return named.select(F.col("stem").cast("int").alias("volume_no"), F.posexplode(F.split("text", r"\r?\n")).alias("line", "text"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """doc (path), line, text of UTF-8 texts."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))


def epub_pages(spark: SparkSession, path: str) -> DataFrame:
    """book, page (name within), html of the text/*.html members of EPUB files, one file at a time in the workers."""
    import pyarrow as pa

    def run(batches):
        import io
        import zipfile

        for batch in batches:
            rows = []
            for book, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    rows += [(book, name, z.read(name).decode("utf-8", "replace")) for name in sorted(z.namelist()) if "text/" in name and name.endswith(".html")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 3)], names=["book", "page", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    return files.select("path", "content").mapInArrow(run, "book string, page string, html string")


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str, array: bool = False, strict: bool = False) -> DataFrame:
    """Rows of JSON lines, or of one JSON array per file; invalid rows are skipped, or raise if strict."""
    reader = spark.read.schema(schema).option("multiLine", str(array).lower()).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(path)


def json_family(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """Rows of a JSON file of either kind, whatever its name says: an array if the first character that is not blank is [, else JSON lines."""
    first = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").limit(1).collect()
    return json_rows(spark, path, schema, array=bool(first) and first[0]["v"].startswith("["), strict=strict)


def valid(rows: DataFrame, enums: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Rows whose enumerations hold known values and whose required columns are filled."""
    for column, values in enums.items():
        rows = rows.where(F.coalesce(F.col(column).isin(values), F.lit(False)))
    for column in required:
        rows = rows.where(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) != "")
    return rows


def selected_rows(rows: DataFrame, order: str, start: int = 0, limit: int | None = None, id_col: str | None = None, id_value: object = None) -> DataFrame:
    """Rows from an ordinal on, at most limit of them; or the row of one id."""
    if id_col is not None:
        return rows.where(F.col(id_col) == F.lit(id_value))
    rows = rows.where(F.col(order) >= start)
    return rows if limit is None else rows.orderBy(order).limit(limit)


def commentary_chunks(rows: DataFrame) -> DataFrame:
    """Commentary records in the form of chunks, with their constant priority."""
    return rows.select(F.col("commentary_id").alias("chunk_id"), F.col("commentary_text").alias("retrieval_text"), F.lit("commentary").alias("chunk_type"), F.lit(0.86).alias("source_priority"))


def tagging_chunks(rows: DataFrame) -> DataFrame:
    """Tagging chunks in the form of retrieval chunks: title, year and text joined, with their constant priority."""
    filled = [F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in ("chapter_title", "year_title", "white_text")]
    return rows.select("chunk_id", F.concat_ws("\n", *filled).alias("retrieval_text"), F.lit("fact").alias("chunk_type"), F.lit(0.88).alias("source_priority"))


def pending(rows: DataFrame, outputs: DataFrame, cases: DataFrame | None, id_col: str = "chunk_id", case_ids: str = "chunk_ids") -> DataFrame:
    """Rows that are in no output and in no case."""
    done = outputs.select(id_col)
    if cases is not None:
        done = done.union(cases.select(F.explode(case_ids).alias(id_col)))
    return rows.join(done.distinct(), id_col, "left_anti")


def with_changed_headings(sections: DataFrame, doc: str, order: str, levels: list[str], text: str) -> DataFrame:
    """doc, order, line: an export in which a heading stands only where it changes."""
    w = Window.partitionBy(doc).orderBy(order)
    heads, outer = [], F.lit(False)
    for i, level in enumerate(levels):
        outer = outer | ~F.col(level).eqNullSafe(F.lag(level).over(w)) | (F.row_number().over(w) == 1)
        heads.append(F.when(outer & (F.coalesce(level, F.lit("")) != ""), F.concat(F.lit("#" * (i + 1) + " "), F.col(level))))
    lines = F.array_compact(F.array(*heads, F.col(text)))
    return sections.select(doc, order, lines.alias("lines")).select(doc, order, F.posexplode("lines").alias("place", "line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, UTF-8; a byte order mark would stand in every part file, so there is none."""
    rows.write.mode("errorifexists").option("header", "true").option("escape", "\"").csv(path)


def write_json(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "errorifexists").json(path)


def is_current(spark: SparkSession, built: str, source: str) -> bool:
    """Whether the written table at `built` is newer than every file of `source`."""
    newest = lambda path: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.max("modificationTime")).first()[0]
    try:
        there = newest(built)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return there is not None and there >= newest(source)


def vector_index(vectors: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row that tells whether an index is still that of these rows: n, and a sum of row hashes."""
    return vectors.agg(F.count("*").alias("n"), F.sum(F.xxhash64(id_col, text_col).cast("decimal(38,0)")).cast("string").alias("signature"))


def stored_vectors(spark: SparkSession, folder: str, rows: DataFrame, id_col: str, text_col: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """id, vector of the rows: read from `folder` if they are those of these rows, else encoded in the workers and written there, beside older ones.

    encode: a function of a batch of texts that the workers can import. The version of a table is its signature (vector_index).
    """
    told = vector_index(rows, id_col, text_col).first()
    path = f"{folder}/v-{told['n']}-{told['signature'] or 0}"

    def batches(of):
        import pyarrow as pa

        for batch in of:
            vectors = encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "vector"])

    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string")).mapInArrow(batches, "id string, vector array<double>").write.mode("overwrite").parquet(path)
    return spark.read.schema("id string, vector array<double>").parquet(path)
