"""Review CSV files, game catalogue, topic-word files."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from reviewlens.scale import cut_lineage, fits_broadcast
from reviewlens.sources import schemas

# Blanks around a value belong to it; Spark's writer would cut them off.
CSV_OPTIONS = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
RECORD_OPTIONS = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Files of one column order; texts may hold quotes and newlines."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(paths)


def _lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Every line with its file, the block of the file it lies in and a number that grows inside a block."""
    lines = spark.read.option("lineSep", "\n").text(pattern).select("value", "_metadata.file_path", "_metadata.file_block_start")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.col("file_path").alias("path"), F.col("file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), (quotes % 2 == 1).alias("odd"), "value",
    )


def _blocks(lines: DataFrame) -> DataFrame:
    """(path, block, first, open, left_open): whether a block begins and ends inside quotes.

    Only the counts of a block's quotes are brought together; a file has one row per block.
    """
    counted = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.sum(F.col("odd").cast("int")).alias("n"))
    until = F.sum("n").over(Window.partitionBy("path").orderBy("block"))
    return counted.select("path", "block", "first", ((until - F.col("n")) % 2 == 1).alias("open"), (until % 2 == 1).alias("left_open"))


def _in_blocks(lines: DataFrame, blocks: DataFrame, few: bool) -> DataFrame:
    """The lines, in their order, with what is known of their block."""
    joined = lines.join(F.broadcast(blocks) if few else blocks, ["path", "block"])
    return joined.sortWithinPartitions("path", "block", "at")


def _pieces(crossing: bool):
    """Function from the lines of whole blocks to records, or to the parts of those that cross a border."""

    def run(batches):
        import pyarrow as pa

        place, held, inside, cut = None, [], False, False  # of the record that is being read
        made = {"path": [], "block": [], "header": [], "part": [], "value": []}

        def put(part):
            if (part is None) != crossing and held:
                for name, value in zip(made, (*place, part, "\n".join(held))):
                    made[name].append(value)
            held.clear()

        def batch_of():
            types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made.values(), types)], list(made))
            for values in made.values():
                values.clear()
            return batch

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "block", "header", "open", "odd", "value"))
            for path, block, header, opened, odd, line in zip(*columns):
                if (path, block, header) != place:
                    if held:  # the block before ended inside quotes
                        put(CUT_WHOLE if cut else CUT_END)
                    place, inside, cut = (path, block, header), opened, opened
                held.append(line)
                inside ^= odd
                if not inside:
                    put(CUT_START if cut else None)
                    cut = False
            if made["path"]:
                yield batch_of()
        if held:
            put(CUT_WHOLE if cut else CUT_END)
        if made["path"]:
            yield batch_of()

    return run


#: Parts of a record that crosses borders: its first, one that fills a block, its last.
CUT_END, CUT_WHOLE, CUT_START = 0, 1, 2
_PIECE = "path string, block long, header string, part int, value string"


def _records(spark: SparkSession, pattern: str) -> tuple[DataFrame, list[str]]:
    """(header, value) of the records of all files, and the different header lines."""
    lines = _lines(spark, pattern)
    blocks = cut_lineage(_blocks(lines))
    few = fits_broadcast(blocks)
    first = blocks.where("block = 0").select("path", F.col("first").alias("at"))
    header = F.regexp_replace("value", "^\ufeff|\r$", "").alias("header")
    headers = cut_lineage(lines.join(F.broadcast(first) if few else first, ["path", "at"]).select("path", header))
    known = cut_lineage(blocks.join(headers, "path"))
    read = _in_blocks(lines, known, few).where("NOT (block = 0 AND at = first)")
    whole = read.mapInArrow(_pieces(False), _PIECE)
    borders = known.where("open OR left_open")
    parts = _in_blocks(lines, borders, few).where("NOT (block = 0 AND at = first)").mapInArrow(_pieces(True), _PIECE)
    begun = F.sum((F.col("part") == CUT_END).cast("int")).over(Window.partitionBy("path").orderBy("block", F.desc("part")))
    joined = parts.withColumn("record", begun).groupBy("path", "header", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), "\n").alias("value")
    )
    found = whole.select("header", "value").unionByName(joined.select("header", "value"))
    distinct = [r["header"] for r in headers.select("header").distinct().orderBy("header").collect()]  # column orders
    return found.where(F.trim(F.regexp_replace("value", "\r$", "")) != ""), distinct


def read_reviews(spark: SparkSession, pattern: str) -> DataFrame:
    """Union of review files by column name; columns a file lacks are null.

    Files are read in blocks, also where texts hold newlines: the parity of the quotes before
    a block tells whether it begins inside a text, and records that cross a border are put
    together from their parts.  Quotes stand around fields and are doubled inside them, as
    writers of CSV set them; a text whose quote is never closed reaches to the end of its file.
    Files of one header, whatever their number, are parsed together in its column order.
    """
    try:
        records, headers = _records(spark, pattern)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(pattern) from error
        raise
    if not headers:
        raise FileNotFoundError(pattern)
    orders = []
    for header in headers:
        names = [name or f"_c{i}" for i, name in enumerate(next(csv.reader([header]), []))]
        orders.append((header, T.StructType([T.StructField(n, schemas.KNOWN_TYPES.get(n, T.StringType())) for n in names])))
    columns = {field.name: field.dataType for _, order in orders for field in order}

    def parsed(order):
        """A record of one column order as a struct of all columns; it is parsed once."""
        row = F.from_csv(F.regexp_replace("value", "\r$", ""), order.toDDL(), RECORD_OPTIONS)
        cells = lambda r: [(r[n] if n in order.names else F.lit(None).cast(t)).alias(n) for n, t in columns.items()]
        return F.transform(F.array(row), lambda r: F.struct(*cells(r)))[0]

    rows = F.coalesce(*[F.when(F.col("header") == header, parsed(order)) for header, order in orders])
    return records.select(rows.alias("r")).select("r.*")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(AppID, Name) of the games; the unnamed index column is dropped."""
    return read_csv(spark, path, schemas.CATALOGUE).select("AppID", "Name")


def read_topic_words(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, words): the scores column is never parsed."""
    return read_csv(spark, path, schemas.TOPIC_WORDS).select("topic_id", "words")
