"""Trees given as parent links: closures, context, innermost matters, workflows, UI order and clause building."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docgrid.functions.text import strip
from docgrid.operators.staging import cut

# Numerals, the words of formal levels, the marks of items by rank, and what each level may stand under.
NUMERAL = "[0-9一二三四五六七八九十百千万零〇两]+"
CN = "[一二三四五六七八九十百千万零〇两]+"
FORMAL = {"book": "编", "chapter": "章", "section": "节", "article": "条", "paragraph": "款"}
ITEM_MARKS = ((1, rf"^({CN})\s*、\s*([\s\S]*)$", "{}、"), (2, rf"^[（(]\s*({CN})\s*[）)]\s*([\s\S]*)$", "（{}）"), (4, r"^[（(]\s*([0-9]+)\s*[）)]\s*([\s\S]*)$", "（{}）"), (3, r"^([0-9]+)\s*[.、．](?![0-9])\s*([\s\S]*)$", "{}."))
BOOK, CHAPTER, SECTION, ARTICLE, PARAGRAPH, PREAMBLE = 0, 1, 2, 3, 4, 9
UNDER = {BOOK: (), CHAPTER: (BOOK,), SECTION: (BOOK, CHAPTER), ARTICLE: (BOOK, CHAPTER, SECTION), PARAGRAPH: (ARTICLE,), PREAMBLE: ()}
ORDER_WORDS = ("首先", "其次", "然后", "之后", "最后", "审核后", "批准后", "经.+后", "第一步", "第二步", "第三步")
MATTER_TITLE = "申请|申报|办理|审批|认定|报销|聘任|变更|终止|登记|备案|采购|验收|入学|毕业|资助"


def closure(nodes: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(ancestor, descendant, distance) for every proper pair, whatever the depth; the shortest distance in a cycle."""
    return reach(nodes, key, parent).filter("ancestor <> descendant")


def reach(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """The closure by doubling: after k rounds it has all distances up to 2^k, and it ends when a round finds no new pair.

    A node in a cycle reaches itself.
    """
    found = nodes.filter(F.col(parent).isNotNull()).select(F.col(key).cast("string").alias("descendant"), F.col(parent).cast("string").alias("ancestor"), F.lit(1).alias("distance")).distinct()
    pairs, before = cut(found), -1
    while (now := pairs.count()) != before:
        before = now
        on = pairs.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("up"), F.col("distance").alias("more"))
        longer = pairs.join(on, "ancestor").select("descendant", F.col("up").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        pairs = cut(pairs.unionByName(longer).groupBy("descendant", "ancestor").agg(F.min("distance").alias("distance")))
    return pairs.select("ancestor", "descendant", "distance")


def around(hits: DataFrame, nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(ancestor, descendant, distance) of the hits (column id) and all above and below them, a level at a time.

    Only the levels' nodes are joined, not the whole closure; a node that was met is not gone through again.
    """
    links = nodes.filter(F.col(parent).isNotNull()).select(F.col(key).cast("string").alias("below"), F.col(parent).cast("string").alias("above"))
    out = None
    for here, there in (("below", "above"), ("above", "below")):
        front, seen, distance = hits.select("id", F.col("id").alias("at")).distinct(), None, 0
        while True:
            distance += 1
            step = front.join(links, F.col("at") == F.col(here)).select("id", F.col(there).alias("at")).distinct().filter("id <> at")
            step = cut(step if seen is None else step.join(seen.select("id", "at"), ["id", "at"], "left_anti"))
            if step.isEmpty():
                break
            front, met = step, step.withColumn("distance", F.lit(distance))
            seen = met if seen is None else seen.unionByName(met)
        if seen is not None:
            up, down = ("at", "id") if there == "above" else ("id", "at")
            pairs = seen.select(F.col(up).alias("ancestor"), F.col(down).alias("descendant"), "distance")
            out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        return hits.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("distance")).limit(0)
    return out.groupBy("ancestor", "descendant").agg(F.min("distance").alias("distance"))


def context(hits: DataFrame, pairs: DataFrame, most: int = 40) -> DataFrame:
    """id, related (ancestors and descendants in order of id, at most ``most``), truncated.

    Relatives are ranked and cut before they are collected, so that a hit with very many of them is no large array.
    """
    near = pairs.select(F.col("descendant").alias("id"), F.col("ancestor").alias("other")).unionByName(pairs.select(F.col("ancestor").alias("id"), F.col("descendant").alias("other")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("other"))
    got = hits.select("id").distinct().join(near.distinct(), "id").withColumn("place", place).filter(F.col("place") <= most + 1)
    got = got.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("all"))
    out = hits.select("id").join(got, "id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<string>")))
    return out.select("id", F.slice("all", 1, most).alias("related"), (F.size("all") > most).alias("truncated"))


def innermost(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates that have no candidate below them."""
    below = pairs.join(candidates.select(F.col("id").alias("descendant")), "descendant", "left_semi").select(F.col("ancestor").alias("id"))
    return candidates.join(below, "id", "left_anti")


def explicit_matters(nodes: DataFrame, pairs: DataFrame, evidence: DataFrame, title_like: str = MATTER_TITLE) -> DataFrame:
    """Innermost structural nodes whose title matches and under which some node has evidence (column id).

    ``nodes`` has id, title, structural.
    """
    named = nodes.filter(F.col("structural") & F.col("title").rlike(title_like)).select("id", "title")
    proved = pairs.join(evidence.select(F.col("id").alias("descendant")).distinct(), "descendant", "left_semi").select(F.col("ancestor").alias("id")).distinct()
    return innermost(named.join(proved, "id", "left_semi"), pairs)


def workflow_view(members: DataFrame, matter: str, order: str, text: str, words: tuple[str, ...] = ORDER_WORDS) -> DataFrame:
    """matter, n_steps, order_confirmed: the order is confirmed if all later steps name it."""
    rn = F.row_number().over(Window.partitionBy(matter).orderBy(order))
    m = members.withColumn("__n", rn).withColumn("__said", F.col(text).rlike("|".join(words)))
    return m.groupBy(matter).agg(F.count("*").alias("n_steps"), ((F.count("*") >= 2) & F.coalesce(F.bool_and(F.when(F.col("__n") > 1, F.col("__said"))), F.lit(False))).alias("order_confirmed"))


def ui_tree(nodes: DataFrame, key: str, parent: str, order: str) -> DataFrame:
    """id, root, level, path (order values from the root): nodes with a missing parent and those in a cycle are roots."""
    n = nodes.select(F.col(key).cast("string").alias("id"), F.col(parent).cast("string").alias("p"), F.col(order).cast("long").alias("o"))
    has = n.select(F.col("id").alias("p")).withColumn("known", F.lit(True))
    n = n.join(has, "p", "left").withColumn("p", F.when(F.col("known"), F.col("p"))).drop("known")
    all_pairs = reach(n, "id", "p")
    cyclic = all_pairs.filter("ancestor = descendant").select(F.col("descendant").alias("c")).distinct()
    # a walk up ends at the first node of a cycle, which is a root
    first = all_pairs.join(cyclic, F.col("ancestor") == F.col("c")).groupBy("descendant").agg(F.min("distance").alias("stop"))
    first = first.join(cyclic, F.col("descendant") == F.col("c"), "left").select("descendant", F.when(F.col("c").isNotNull(), 0).otherwise(F.col("stop")).alias("stop"))
    pairs = all_pairs.join(first, "descendant", "left").filter(F.col("stop").isNull() | (F.col("distance") <= F.col("stop"))).drop("stop")
    up = pairs.join(n.select(F.col("id").alias("ancestor"), F.col("o").alias("ao")), "ancestor").groupBy(F.col("descendant").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ao", "ancestor"))).alias("up"))
    out = n.join(up, "id", "left").withColumn("up", F.coalesce("up", F.array().cast("array<struct<d:int,ao:bigint,ancestor:string>>")))
    path = F.concat(F.transform("up", lambda x: F.lpad(x["ao"].cast("string"), 8, "0")), F.array(F.lpad(F.col("o").cast("string"), 8, "0")))
    return out.select("id", F.coalesce(F.get("up", F.lit(0))["ancestor"], F.col("id")).alias("root"), F.size("up").alias("level"), F.array_join(path, "/").alias("path"))


def marked_lines(lines: DataFrame) -> DataFrame:
    """Lines cut at articles within them, with mark (level, label, rest, slot) where one begins a clause; blank lines go."""
    line = strip(F.col("line"))
    article = rf"第\s*{NUMERAL}\s*条"
    parts = F.when(line.rlike(f"^{article}"), F.split(line, rf"(?<=\s)(?={article})")).otherwise(F.array(line))
    cut_up = lines.select("policy_id", "page", "ordinal", "line_no", F.posexplode(parts).alias("part_no", "part")).withColumn("part", strip(F.col("part"))).filter("part <> ''")
    mark = lambda level, label, rest, slot: F.struct(F.lit(level).alias("level"), label.alias("label"), strip(rest).alias("rest"), F.lit(slot).alias("slot"))
    found = []
    for slot, (level, word) in enumerate(FORMAL.items()):
        pattern = rf"^第\s*({NUMERAL}(?:\s+{NUMERAL})*)\s*{word}\s*([\s\S]*)$"
        number = F.replace(F.regexp_extract("part", pattern, 1), F.lit(" "), F.lit(""))
        found.append(F.when(F.col("part").rlike(pattern), mark(level, F.concat(F.lit("第"), number, F.lit(word)), F.regexp_extract("part", pattern, 2), slot)))
    for rank, pattern, shape in ITEM_MARKS:
        before, after = shape.split("{}")
        label = F.concat(F.lit(before), strip(F.regexp_extract("part", pattern, 1)), F.lit(after))
        found.append(F.when(F.col("part").rlike(pattern), mark("item", label, F.regexp_extract("part", pattern, 2), PARAGRAPH + rank)))
    return cut_up.withColumn("mark", F.coalesce(*found))


def build_clauses(lines: DataFrame) -> DataFrame:
    """Clause trees of documents from their ordered lines (policy_id, page, ordinal, line_no, line).

    Returns policy_id, sequence_no, parent_no, level, label, article_no, paragraph_no, item_no, chapter_path, raw_text,
    page_start, page_end.  Lines are marked and gathered into clauses by Spark; the clauses stream through a stack, one
    document after another.
    """
    order = ["page", "ordinal", "line_no", "part_no"]
    each = Window.partitionBy("policy_id").orderBy(*order)
    first = F.struct(F.lit("preamble").alias("level"), F.lit("前言").alias("label"), F.col("part").alias("rest"), F.lit(PREAMBLE).alias("slot"))
    m = marked_lines(lines).withColumn("begins", F.when(F.row_number().over(each) == 1, F.coalesce("mark", first)).otherwise(F.col("mark")))
    m = m.withColumn("sequence_no", F.count("begins").over(each).cast("int"))
    said = F.when(F.col("begins").isNotNull(), strip(F.concat_ws(" ", "begins.label", "begins.rest"))).otherwise(F.col("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, said.alias("said")))), lambda x: x["said"]), "\n")
    nodes = m.groupBy("policy_id", "sequence_no").agg(F.max("begins").alias("b"), text.alias("raw_text"), F.min_by("page", F.struct(*order)).alias("page_start"), F.max("page").alias("page_end"))
    numbered = F.min("b.slot").over(Window.partitionBy("policy_id")) > PARAGRAPH
    nodes = nodes.select("policy_id", "sequence_no", "b.level", "b.label", "b.slot", numbered.alias("numbered"), "raw_text", "page_start", "page_end")
    # clauses stream through in order with all they have, so nothing is made twice to be joined
    dealt = nodes.filter("policy_id IS NOT NULL").repartition("policy_id").sortWithinPartitions("policy_id", "sequence_no")
    schema = StructType([*dealt.schema.fields, *StructType.fromDDL("parent_no int, article_no string, chapter_path array<string>")])
    number = F.expr("substring(label, 2, length(label) - 2)")
    return dealt.mapInArrow(_stacked, schema).select(
        "policy_id", "sequence_no", "parent_no", "level", "label", "article_no", F.when(F.col("level") == "paragraph", number).otherwise("").alias("paragraph_no"),
        F.when(F.col("level") == "item", F.col("label")).otherwise("").alias("item_no"), "chapter_path", "raw_text", "page_start", "page_end",
    )


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents by a stack of open slots: a clause closes all slots that it can't stand under, then stands under the top.

    Items stand under articles and paragraphs; under items of a higher rank too, if the document has no formal level or
    an article or paragraph is open.  Documents follow one another, and only the open slots of one are held.
    """
    document, free = None, False
    open_: list[tuple[int, int, str]] = []
    for b in batches:
        parents, articles, paths = [], [], []
        for policy, number, slot, label, numbered in zip(*(b.column(c).to_pylist() for c in ("policy_id", "sequence_no", "slot", "label", "numbered")), strict=True):
            if policy != document:
                document, free, open_ = policy, numbered, []
            if slot in UNDER:
                under = UNDER[slot]
            else:
                outer = [s for s, _, _ in open_ if s <= PARAGRAPH or s == PREAMBLE]
                nested = free or (outer and outer[-1] in (ARTICLE, PARAGRAPH))
                under = (ARTICLE, PARAGRAPH, *(range(PARAGRAPH + 1, slot) if nested else ()))
            while open_ and open_[-1][0] not in under:
                open_.pop()
            parents.append(open_[-1][1] if open_ else None)
            open_.append((slot, number, label))
            articles.append(next((x[1:-1] for s, _, x in open_ if s == ARTICLE), ""))
            paths.append([x for s, _, x in open_ if s <= SECTION])
        more = [pa.array(parents, pa.int32()), pa.array(articles, pa.string()), pa.array(paths, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "parent_no", "article_no", "chapter_path"])


def parse_quality(blocks: DataFrame, clauses: DataFrame, key: str = "policy_id") -> DataFrame:
    """key, quality (0 to 1, four places) from text coverage, boxes and replacement characters.

    ``blocks`` has type, content, table_html, bbox; ``clauses`` has raw_text.
    """
    text = F.coalesce(F.when(F.col("content") != "", F.col("content")), F.col("table_html"), F.lit(""))
    b = blocks.withColumn("t", text).filter(F.col("type").isin("text", "table") & (F.trim("t") != ""))
    bad = F.length("t") - F.length(F.replace(F.col("t"), F.lit("�"), F.lit("")))
    b = b.groupBy(key).agg(F.sum(F.length("t")).alias("chars"), F.sum(bad).alias("bad"), F.avg(F.when(F.size("bbox") >= 4, 1.0).otherwise(0.0)).alias("boxed"))
    c = clauses.groupBy(key).agg(F.sum(F.length("raw_text")).alias("said"))
    q = 0.45 * F.least(F.lit(1.0), F.coalesce("said", F.lit(0)) / F.greatest("chars", F.lit(1))) + 0.25 * F.col("boxed") + 0.30 * F.greatest(F.lit(0.0), 1 - 20 * F.col("bad") / F.greatest("chars", F.lit(1)))
    return b.join(c, key, "left").select(key, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)), 4).alias("quality"))
