"""Assembly of ordered blocks into sections, budgets, siblings and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.text import strip

# What begins a section in each kind of document.
ACADEMIC_HEADING = r"(?i)^(Abstract|Introduction|Method|Experiment|Conclusion|References|附录|第[一二三四五六七八九十]+章|\d+\.?\s+[A-Za-z])"
ARTICLE_HEADING = r"^第[一二三四五六七八九十百]+条"
POLICY_HEADING = (
    r"^(?:第\s*[0-9一二三四五六七八九十百千万零〇两]+\s*(?:编|章|节)|[一二三四五六七八九十百千万零〇两]+\s*[、．.]\s*|"
    r"[（(]\s*(?:[一二三四五六七八九十百千万零〇两]+|\d+)\s*[）)]\s*|\d+\s*[、．.](?!\d)\s*|\d+(?:[.．]\d+)+[ \t]+)"
)
CHUNK, OVERLAP, PART = 512, 50, 256


def assemble(blocks: DataFrame, document: str, order: list[str], text: str, is_heading: Column) -> DataFrame:
    """document, section_no (from 1), text: a heading begins a section and what follows is appended.

    Blank texts are left out; what stands before the first heading is a section of its own.
    """
    b = blocks.withColumn("__text", strip(F.col(text))).filter("__text <> ''")
    w = Window.partitionBy(document).orderBy(*order)
    starts = F.when(is_heading | (F.row_number().over(w) == 1), 1).otherwise(0)
    b = b.withColumn("__start", starts).withColumn("section_no", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col("__text").alias("t"))
    return b.groupBy(document, "section_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n").alias("text"), F.count("*").alias("n_blocks"))


def policy_lines(blocks: DataFrame, document: str, order: list[str], text: str) -> DataFrame:
    """A row for each line of the blocks, with line_no within its block."""
    return blocks.select(document, *order, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("line_no", "line"))


def prefix_budget(blocks: DataFrame, document: str, order: list[str], text: str, budget: int = 6000) -> DataFrame:
    """The beginning of each document's text within a budget of characters, block by block."""
    w = Window.partitionBy(document).orderBy(*order)
    used = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = blocks.withColumn("__used", used).filter(F.col("__used") < budget)
    return b.withColumn("kept", F.substr(F.col(text), F.lit(1), (budget - F.col("__used")).cast("int"))).drop("__used")


def siblings(rows: DataFrame, parent: str, order: list[str], key: str) -> DataFrame:
    """Previous and next row of the same parent."""
    w = Window.partitionBy(parent).orderBy(*order)
    return rows.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed into chunks of ``size`` characters; a longer paragraph is cut with an overlap."""
    paragraphs = F.filter(F.transform(F.split(text, "\r\n|\n"), strip), lambda p: p != "")
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("now"), none.alias("part"), F.array().cast("array<array<string>>").alias("done"))

    # chunks are gathered in parts, so that a long text's are copied a few times and not once for each paragraph
    def pack(state, p):
        now, part, done = state["now"], state["part"], state["done"]
        fits, long = F.length(now) + F.length(p) + 1 <= size, F.length(p) > size
        flushed = F.when(now != "", F.array(now)).otherwise(none)
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(p) - 1, F.lit(0)), F.lit(size - overlap)), lambda s: F.substr(p, s + 1, F.lit(size)))
        out = F.when(fits, none).when(long, F.concat(flushed, cut)).otherwise(flushed)
        then = F.when(fits, F.when(now == "", p).otherwise(F.concat(now, F.lit("\n"), p))).when(long, F.lit("")).otherwise(p)
        full = F.size(part) >= PART
        return F.struct(then.alias("now"), F.when(full, out).otherwise(F.concat(part, out)).alias("part"), F.when(full, F.concat(done, F.array(part))).otherwise(done).alias("done"))

    last = lambda s: F.when(s["now"] != "", F.array(s["now"])).otherwise(none)
    return F.aggregate(paragraphs, start, pack, lambda s: F.concat(F.flatten(s["done"]), s["part"], last(s)))


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index, chunk_id, text of every chunk."""
    c = docs.select(key, F.posexplode(chunks(F.col(text), size, overlap)).alias("chunk_index", "text"))
    return c.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")))
