"""Delimited text, partitioned writes, JSON columns and HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.groupjoin import BROADCAST_ROWS
from tessera.session import scratch_dir

CORRUPT = "_corrupt_record"


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                   encoding: str = "utf-8", locale: str = "en-US", date_format: str | None = None,
                   header: bool = True, keep_corrupt: bool = True, multiline: bool = False, escape: str = "\\") -> DataFrame:
    """Typed read of delimited text. Rows that do not parse are kept, with NULL
    fields and the raw line in ``_corrupt_record`` (PERMISSIVE mode). The text
    tokens "" and "NA" read as NULL. For cp1252 files the session must have
    ``spark.sql.legacy.javaCharsets=true``, which only its owner sets; ISO-8859-1
    differs in 0x80-0x9F.

    With ``multiline`` quoted fields may hold line breaks (see ``quoted_records``); files are still
    read in splits. ``escape`` is what stands before a quote inside quotes: a backslash, or a quote for doubled quotes."""
    if encoding.lower().replace("_", "-") in ("cp1252", "windows-1252"):
        if str(spark.conf.get("spark.sql.legacy.javaCharsets", "false")).lower() != "true":
            raise ValueError("set spark.sql.legacy.javaCharsets=true to read cp1252 files")
        encoding = "windows-1252"
    fields = list(schema.fields)
    if keep_corrupt and CORRUPT not in schema.fieldNames():
        fields.append(T.StructField(CORRUPT, T.StringType(), True))
    options = {"sep": sep, "locale": locale, "mode": "PERMISSIVE", "nullValue": "NA", "escape": escape}
    if keep_corrupt:
        options["columnNameOfCorruptRecord"] = CORRUPT
    if date_format:
        options["dateFormat"] = date_format
    if multiline:
        records = quoted_records(spark, path, encoding, header, escape)
        parsed = records.select(F.from_csv("record", T.StructType(fields).toDDL(), options).alias("r"))
        return parsed.select("r.*")
    return (spark.read.schema(T.StructType(fields)).options(**options)
            .option("header", str(header).lower()).option("encoding", encoding).option("emptyValue", None).csv(path))


def quoted_records(spark: SparkSession, path: str, encoding: str = "utf-8", header: bool = True, escape: str = "\\") -> DataFrame:
    """The records of delimited text whose quoted fields may hold line breaks, one per row (``record``), raw.

    Files are read as lines, in splits. Whether a line begins inside quotes follows from the number of quotes before it
    in its file, odd or even: one aggregate counts them per split, a running sum over the splits of a file (one row
    each) tells every split how it begins, and a second pass puts lines together in the order of reading. Only what
    reaches over the end of a split is shuffled, at most two pieces of each. A quote that is never closed takes the
    rest of its file into one bad record. ``header`` leaves out each file's first record; empty lines are no records."""
    import pyarrow as pa

    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.decode(F.col("value").cast("binary"), encoding).alias("line"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    plain = F.regexp_replace("line", r"\\.", "") if escape == "\\" else F.col("line")
    lines = lines.withColumn("quotes", F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit(""))))
    splits = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select(F.col("file").alias("__file"), F.col("block").alias("__block"),
                           (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("inside"))
    scratch_dir(spark)
    begins = begins.checkpoint()
    same = (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))
    lines = lines.withColumn("__row", F.monotonically_increasing_id())
    if begins.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        lines = lines.join(F.broadcast(begins), same)  # rows stay where and in the order they are read
    else:
        lines = lines.join(begins, same).sortWithinPartitions("file", "block", "__row")
    lines = lines.select("line", "file", "block", "quotes", "inside")

    def run(batches):
        split, inside, parts, skip, continues = None, False, [], False, False
        out = {"record": [], "file": [], "block": [], "kind": []}

        def put(kind):
            nonlocal skip
            text = "\n".join(parts)
            if kind == WHOLE and text.endswith("\r"):
                text = text[:-1]
            if kind == WHOLE and skip:
                skip = False
            elif kind != WHOLE or text:
                for c, v in zip(out, (text, *split, kind)):
                    out[c].append(v)
            parts.clear()

        def batch():
            got = pa.RecordBatch.from_pydict(out, schema=pa.schema([("record", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32())]))
            for c in out.values():
                c.clear()
            return got

        for b in batches:
            for line, file, block, quotes, start in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != split:
                    if parts:
                        put(BEGUN if not continues else GOES_ON)
                    split, inside, continues = (file, block), bool(start), bool(start)
                    skip = header and block == 0
                parts.append(line)
                inside ^= bool(quotes & 1)
                if not inside:
                    put(ENDS if continues else WHOLE)
                    continues = False
            if len(out["record"]):
                yield batch()
        if parts:
            put(BEGUN if not continues else GOES_ON)
            yield batch()

    pieces = lines.mapInArrow(run, "record string, file string, block long, kind int")
    whole = pieces.where(F.col("kind") == WHOLE).select("record")
    # a record over several splits: begun in one, ending in another, some between
    cut = pieces.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == BEGUN)
    cut = cut.withColumn("number", F.sum(F.when(F.col("kind") == BEGUN, 1).otherwise(0)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", F.col("kind") == BEGUN, "record")))
    joined = cut.groupBy("file", "number").agg(F.concat_ws("\n", F.transform(parts, lambda x: x["record"])).alias("record"))
    return whole.unionByName(joined.select(F.regexp_replace("record", "\r$", "").alias("record")))


#: How a piece lies in its split: a whole record, the end of an earlier split's, one that goes on after this split, one begun in it.
WHOLE, ENDS, GOES_ON, BEGUN = range(4)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> str:
    df.write.mode("overwrite").option("sep", sep).option("header", str(header).lower()).csv(path)
    return path


def write_partitioned(df: DataFrame, path: str, fmt: str = "parquet", by=()) -> str:
    """Write partitioned by ``by`` columns (one folder per value). Rows are first
    rebalanced on the partition columns: AQE joins small values into one task
    and splits a large one over several, each writing a file of its own."""
    by = list(by)
    w = df.hint("rebalance", *by) if by else df
    w.write.mode("overwrite").format(fmt).partitionBy(*by).save(path)
    return path


def read_partitioned(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read back; filters on partition columns prune folders (PartitionFilters)."""
    return spark.read.format(fmt).load(path)


def json_column(df: DataFrame, col: str, schema: T.StructType | str, prefix: str = "") -> DataFrame:
    """Typed fields of a JSON text column, parsed once per row (``from_json``);
    malformed JSON gives NULL fields."""
    parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})
    tmp = df.withColumn("__j", parsed)
    names = tmp.schema["__j"].dataType.fieldNames()
    return tmp.select(*df.columns, *[F.col("__j." + n).alias(prefix + n) for n in names])


HTML_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("n_links", T.IntegerType()),
    T.StructField("text_chars", T.IntegerType()),
])


def _parse_pages(batches):
    from html.parser import HTMLParser

    class P(HTMLParser):
        SKIP = {"script", "style", "noscript", "template"}
        HEAD = SKIP | {"head", "html", "title", "meta", "link", "base"}

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.title, self.in_title, self.links, self.depth, self.text, self.in_head = [], False, 0, 0, [], False

        def handle_starttag(self, tag, attrs):
            # the end tag of a head is optional: the first element that can't be in one ends it
            self.in_head = tag in self.HEAD and (self.in_head or tag == "head")
            if tag == "title":
                self.in_title = True
            if tag in self.SKIP:
                self.depth += 1
            if tag == "a" and any(k == "href" for k, _ in attrs):
                self.links += 1

        def handle_endtag(self, tag):
            if tag == "title":
                self.in_title = False
            if tag == "head":
                self.in_head = False
            if tag in self.SKIP and self.depth:
                self.depth -= 1

        def handle_data(self, data):
            if self.in_title:
                self.title.append(data)
            elif not self.depth:
                self.in_head = self.in_head and not data.strip()
                if not self.in_head:
                    self.text.append(data)

    import pandas as pd

    for pdf in batches:
        titles, links, chars = [], [], []
        for html in pdf["html"]:
            p = P()
            if html is not None:
                p.feed(html)
                p.close()
            titles.append(" ".join("".join(p.title).split()) or None)
            links.append(p.links)
            chars.append(len(" ".join(" ".join(p.text).split())))
        yield pd.DataFrame({"page_id": pdf["page_id"], "title": titles,
                            "n_links": pd.Series(links, dtype="int32"),
                            "text_chars": pd.Series(chars, dtype="int32")})


def html_extract(pages: DataFrame) -> DataFrame:
    """Per page: title, number of links (``<a href>``) and the length of its
    visible text (outside head/script/style, whitespace squished). Runs per
    partition with the standard-library parser; no page crosses a task."""
    return pages.select("page_id", "html").mapInPandas(_parse_pages, HTML_SCHEMA)
