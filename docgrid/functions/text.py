r"""Text functions as column expressions, Unicode-safe: ``(?U)`` makes ``\s`` and ``\d`` mean what they mean in Unicode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bracket variants of document numbers, wrappers and suffixes of titles, words of norms and decisions.
OPEN_BRACKETS = "（〔﹝［【("
CLOSE_BRACKETS = "）〕﹞］】)"
NORM_PATTERNS = {
    "obligation": "应当|必须|须(?=[予由向将对按依在于为])|有义务",
    "permission": "可以|可(?=[向由在按依申请办理享有])|有权",
    "prohibition": "不得|严禁|禁止|不允许",
}
ABSOLUTE_DATE = r"(?U)自\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日\s*起\s*(?:施行|执行|生效)"
RELATIVE_DATE = r"(?U)自\s*(?:发布|印发)\s*之日\s*起\s*(?:施行|执行|生效)"
POSITIVE = ("yes", "y", "true", "1", "是", "正确", "通过")
NEGATIVE = ("no", "n", "false", "0", "否", "错误", "不通过")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squash(c: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text_or_blank(c), r"(?U)\s+", "")


def strip(c: Column) -> Column:
    """The text without white space at either end."""
    return F.regexp_replace(text_or_blank(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def evidence_supported(evidence: Column, source: Column) -> Column:
    """Whether the evidence stands in the source when white space is disregarded; blank evidence doesn't."""
    e = squash(evidence)
    return (e != "") & F.contains(squash(source), e)


def normalize_document_number(c: Column) -> Column:
    """One bracket form, no white space, a missing closing bracket put back, no leading zeros in the serial number."""
    t = F.translate(squash(c), OPEN_BRACKETS + CLOSE_BRACKETS, "[" * len(OPEN_BRACKETS) + "]" * len(CLOSE_BRACKETS))
    t = F.regexp_replace(t, r"^([\x{4e00}-\x{9fff}]+字\[)((?:19|20)[0-9]{2})([0-9]{1,6}号)$", "$1$2]$3")
    return F.regexp_replace(t, r"(\[[0-9]{4}\])0+([0-9]+号)$", "$1$2")


def display_document_number(c: Column) -> Column:
    return F.translate(normalize_document_number(c), "[]", "〔〕")


def publication_year(doc_number: Column, issue_date: Column) -> Column:
    """The bracketed year of the document number, else the year of the issue date."""
    year = F.regexp_extract(normalize_document_number(doc_number), r"\[((?:19|20)[0-9]{2})\]", 1)
    return F.coalesce(F.when(year != "", year).cast("int"), F.year(issue_date))


def normalize_family_title(c: Column) -> Column:
    """The title without a notice's wrapping and without marks of its version."""
    t = F.regexp_replace(squash(c), r"^关于印发《?(.+?)》?的通知$", "$1")
    t = F.regexp_replace(t, r"[（(](?:修订|试行|暂行)[）)]$", "")
    t = F.regexp_replace(t, r"(?:修订版|试行|暂行)$", "")
    return F.regexp_replace(t, r"^[《》]+|[《》]+$", "")


def parse_date(c: Column) -> Column:
    """A date from year, month and day in ISO, slash or Chinese form; null if there is no such day."""
    found = F.regexp_extract_all(text_or_blank(c), F.lit(r"([0-9]{4})\s*[-/.年]\s*([0-9]{1,2})\s*[-/.月]\s*([0-9]{1,2})"), F.lit(0))
    digits = F.regexp_extract_all(F.get(found, F.lit(0)), F.lit("[0-9]+"), F.lit(0))
    iso = F.concat_ws("-", F.get(digits, F.lit(0)), F.lpad(F.get(digits, F.lit(1)), 2, "0"), F.lpad(F.get(digits, F.lit(2)), 2, "0"))
    return F.try_to_date(iso, "yyyy-MM-dd")


def effective_dates(text: Column) -> Column:
    """All days from which a text says that it is in force, as an array of dates."""
    said = F.regexp_extract_all(text_or_blank(text), F.lit(ABSOLUTE_DATE), F.lit(0))
    return F.array_distinct(F.array_compact(F.transform(said, lambda s: parse_date(F.regexp_replace(s, r"(?U)\s+|自", "")))))


def says_relative_date(text: Column) -> Column:
    return F.rlike(text_or_blank(text), F.lit(RELATIVE_DATE))


def norm_labels(text: Column) -> Column:
    """Norm labels of a clause: those whose words it has, ``other`` for a blank clause, none where a model must decide."""
    found = F.array_compact(F.array(*[F.when(F.rlike(text_or_blank(text), F.lit(p)), F.lit(k)) for k, p in NORM_PATTERNS.items()]))
    return F.when(is_blank(text), F.array(F.lit("other"))).otherwise(found)


def norm_evidence(text: Column) -> Column:
    """The first word that gave each norm label."""
    pairs = [F.when(F.rlike(text_or_blank(text), F.lit(p)), F.struct(F.lit(k).alias("key"), F.regexp_extract(text_or_blank(text), p, 0).alias("value"))) for k, p in NORM_PATTERNS.items()]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def decision(c: Column) -> Column:
    """True or false for the usual words of either, null otherwise."""
    t = F.lower(strip(c))
    return F.when(t.isin(*POSITIVE), True).when(t.isin(*NEGATIVE), False)


def json_payload(c: Column) -> Column:
    """The text between the outermost braces, without code fences; null where there are none."""
    t = F.regexp_replace(text_or_blank(c), "(?m)^```(?:json)?\\s*$", "")
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner)


def query_terms(query: Column, shortest: int = 2, longest: int = 4) -> Column:
    """All distinct runs of two to four characters of a query, spaces disregarded."""
    q = F.lower(squash(query))

    def runs(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.length(q) - (n - 1)), lambda s: F.substr(q, s, F.lit(n)))
        return F.when(F.length(q) >= n, some).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(shortest, longest + 1)]))


def keyword_score(query: Column, text: Column, most: float = 0.15) -> Column:
    """``most`` times the share, by length, of the query's terms that stand in the text; six places."""
    add = lambda a, x: a + F.length(x)

    def score(bound: Column) -> Column:
        total = F.aggregate(bound["terms"], F.lit(0), add)
        hit = F.aggregate(F.filter(bound["terms"], lambda x: F.contains(bound["text"], x)), F.lit(0), add)
        return F.when((total == 0) | (bound["text"] == ""), F.lit(0.0)).otherwise(F.bround(F.least(F.lit(most), most * hit / total), 6))

    # bound, so that no term repeats the work on the text
    return bind(F.struct(query_terms(query).alias("terms"), F.lower(squash(text)).alias("text")), score)
