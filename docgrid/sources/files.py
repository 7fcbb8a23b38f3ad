"""Files as rows: directory scans, hashes, configuration and review tables, image blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.functions import ids, rules
from docgrid.functions.text import bind

SUFFIXES = ("pdf", "doc", "docx")


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, file_name, size, content, file_hash, file_id of the supported files below a folder; lock files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lower(name).rlike(rf"\.(?:{'|'.join(suffixes)})$") & ~name.startswith("~$")
    files = files.filter(wanted).withColumn("file_name", name)
    return files.select("path", "file_name", F.col("length").alias("size"), "modificationTime", "content", ids.file_hash(F.col("content")).alias("file_hash"), ids.file_id(F.col("file_name"), F.col("content")).alias("file_id"))


def is_mhtml(content: Column) -> Column:
    """Whether the bytes are a web archive, whatever the file's name says."""
    head = F.lower(F.decode(F.substr(content, F.lit(1), F.lit(4096)), "ISO-8859-1"))
    head = F.regexp_replace(head, r"^[\x{ef}\x{bb}\x{bf}\x00\r\n \t]+", "")
    return head.startswith("mime-version:") & F.contains(head, F.lit("content-type: multipart/related"))


def parser_kind(name: Column, content: Column) -> Column:
    """docx, mhtml or remote: which parser takes a file."""
    return F.when(F.lower(name).endswith(".docx"), "docx").when(F.lower(name).endswith(".doc") & is_mhtml(content), "mhtml").otherwise("remote")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of strings with a header, quoted line feeds and perhaps a byte order mark."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV folder with a header in the order of ``columns``; the first header cell has a byte order mark."""
    first = f"﻿{columns[0]}"
    df.select(F.col(columns[0]).alias(first), *columns[1:]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_content_lists(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of parsed documents from ``content_list.json`` files: tables, images and texts, with their order."""
    schema = "type string, text string, text_level int, table_body string, table_caption array<string>, img_path string, img_caption array<string>, image_caption array<string>, page_idx int, bbox array<double>"
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.from_json("value", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"}).alias("items"))
    i = raw.select("path", F.posexplode("items").alias("ordinal", "i")).select("path", "ordinal", "i.*")
    kind = F.when(F.col("type") == "table", "table").when(F.col("type").isin("image", "figure", "chart"), "image").otherwise("text")
    caption = F.array_join(F.filter(F.coalesce("table_caption", "img_caption", "image_caption", F.array().cast("array<string>")), lambda c: F.trim(c) != ""), " ")
    content = F.when(kind == "table", F.col("table_body")).when(kind == "image", F.col("img_path")).otherwise(F.col("text"))
    # the position is part of the id, so blocks of a page never share one
    block = F.substr(F.md5(F.concat_ws(":", "path", "page_idx", "type", "ordinal").cast("binary")), F.lit(1), F.lit(12))
    return i.select("path", "ordinal", block.alias("block_id"), kind.alias("type"), F.coalesce("page_idx", F.lit(0)).alias("page_num"), F.coalesce("bbox", F.array().cast("array<double>")).alias("bbox"), F.coalesce(content, F.lit("")).alias("content"), F.when(kind == "table", F.coalesce("table_body", F.lit(""))).otherwise("").alias("table_html"), caption.alias("caption"), F.col("type").alias("raw_type"), "text_level")


def image_bytes(data: Column) -> Column:
    """The bytes of a data URI or of bare base64; null for other text."""
    body = F.regexp_replace(F.regexp_replace(data, r"^data:[^,]*,", ""), r"\s", "")
    return F.when(body.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(body) % 4 == 0), F.unbase64(body))


def image_size(content: Column) -> Column:
    """struct(width, height) from the header of PNG and GIF bytes; null for others."""
    number = lambda head, *at: F.conv(F.concat(*[F.substr(head, F.lit(2 * k + 1), F.lit(2)) for k in at]), 16, 10).cast("int")
    size = lambda head, w, h: F.struct(number(head, *w).alias("width"), number(head, *h).alias("height"))
    png = lambda head: size(head, range(16, 20), range(20, 24))
    gif = lambda head: size(head, (7, 6), (9, 8))
    return bind(F.hex(F.substr(content, F.lit(1), F.lit(24))), lambda head: F.when(head.startswith("89504E47"), png(head)).when(head.startswith("47494638"), gif(head)))


def classify_images(blocks: DataFrame, data: str) -> DataFrame:
    """Image blocks with content, width, height, extension and category; icons are dropped."""
    bytes_of = blocks.withColumn("content_bytes", image_bytes(F.col(data)))

    def facts(content: Column) -> Column:
        size = bind(image_size(content), lambda x: F.struct(F.coalesce(x["width"], F.lit(0)).alias("width"), F.coalesce(x["height"], F.lit(0)).alias("height")))
        return bind(size, lambda x: F.struct(x["width"].alias("width"), x["height"].alias("height"), rules.image_extension(content).alias("extension"), rules.image_class(x["width"], x["height"]).alias("category")))

    return bytes_of.select("*", bind(F.col("content_bytes"), facts).alias("f")).select(*blocks.columns, "content_bytes", "f.*").filter("category <> 'icon'")
