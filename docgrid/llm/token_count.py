"""Token counts by a whole-token shortcut.

Offline, on the driver, each vocabulary string is encoded alone; those that come back as exactly one token are the
shortcut table.  A text falls into pre-tokens that no merge can cross (also proved from the vocabulary); a pre-token
found in the table counts one, and only the rest is merged by the library.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import map_rows

SPACE = "▁"
PRE_TOKEN = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")
BLOCK = 1 << 20
CACHE = 400_000


def prove(proto: bytes) -> frozenset[str]:
    """Check that pre-tokens are independent and return the pre-tokens that are single tokens.

    Raises ValueError if a vocabulary string holds a space mark after another character, or a line feed beside other
    characters: merges could then cross a pre-token border and the shortcut would be unsound.  So it does if the model's
    own specification normalises texts or treats white space in another way, or if the mark alone isn't one token.
    """
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and p != "\n") for p in pieces):
        raise ValueError("a vocabulary string crosses a pre-token border")
    spec = sentencepiece_model_pb2.ModelProto.FromString(proto).normalizer_spec
    if spec.precompiled_charsmap or spec.normalization_rule_tsv:
        raise ValueError("the model normalises texts")
    if not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("the model's white space rules aren't those the pre-tokens assume")
    mark = sp.piece_to_id(SPACE)
    if any(sp.encode(w + " ") != [*sp.encode(w), mark] for w in ("x", "x y", "\n")):
        raise ValueError("a space mark at the end isn't one token")
    whole = [p for p in pieces if PRE_TOKEN.fullmatch(p) and len(p) > 1 and p[0] == SPACE]
    return frozenset(p for p, ids in zip(whole, sp.encode([p[1:] for p in whole], num_threads=1), strict=True) if len(ids) == 1) | {SPACE}


def blocks(marked: str, size: int = BLOCK) -> Iterator[str]:
    """Cuts of a marked text at pre-token borders, so that a very long text is never split into one list."""
    start = 0
    border = re.compile(f"(?<=[^{SPACE}]){SPACE}|\n")
    while len(marked) - start > size:
        cut = border.search(marked, start + size)
        if not cut:
            break
        yield marked[start : cut.start()]
        start = cut.start()
    yield marked[start:]


class Counting:
    """Counts tokens of texts as the model's library does, without begin or end tokens."""

    def __init__(self, proto: bytes, whole: frozenset[str]):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.whole = whole
        self.known: dict[str, int] = dict.fromkeys(whole, 1)

    def merge(self, rest: list[str]) -> None:
        """Learn the counts of pre-tokens that aren't whole tokens."""
        asked = [w if w[0] == "\n" else w[1:] for w in rest]
        for w, ids in zip(rest, self.sp.encode(asked, num_threads=1), strict=True):
            self.known[w] = len(ids) - (w[0] == "\n")

    def count(self, text: str) -> int:
        if not text:
            return 0
        total = 0
        for block in blocks(SPACE + text.replace(" ", SPACE)):
            if len(self.known) > CACHE + len(self.whole):
                self.known = dict.fromkeys(self.whole, 1)
            seen = Counter(PRE_TOKEN.findall(block))
            if rest := [w for w in seen if w not in self.known]:
                self.merge(rest)
            known = self.known
            total += sum([known[w] * n for w, n in seen.items()])
        return total


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``).

    Null or empty text counts zero tokens; white space counts as the model encodes it; repeated rows stay repeated; an
    empty table gives an empty result; other columns are ignored, whatever their names.  Null ids are kept.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        proto = f.read()
    given = spark.sparkContext.broadcast((proto, prove(proto)))  # the model file and at most one string per vocabulary entry

    def make():
        counting = Counting(*given.value)

        def apply(c):
            texts = [t or "" for t in c["text"]]
            n = [counting.count(t) for t in texts]
            return {"doc_id": c["doc_id"], "n_bytes": c["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return apply

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return map_rows(rows, make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
