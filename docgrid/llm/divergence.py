"""Audit of how the sources of a language diverge in their use of terms, by mergeable radix tries.

Every partition counts the terms of its documents in a radix trie over UTF-8 bytes for each language; a leaf has, by
source, the number of documents with the term and of its occurrences.  A trie is given away in fragments that share
their first ``CUT`` bytes and keep each term as what it doesn't share with the term before it.  Fragments are dealt by
ranges of these prefixes, so a task merges what all partitions have below a prefix, and terms that no later fragment can
touch leave the trie in the order of their bytes: memory is bounded by what is open.  The kept terms are read once more,
in that order, when the totals are known: every task adds up the pairs of sources and keeps the best terms of each.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import limited, scratch, split_batch, staged

MIN_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
CUT = 3  # bytes of the prefix by which fragments are dealt
FRAGMENT = 1 << 10  # leaves of a fragment
COUNTERS = 1 << 22  # counters of leaves and sources that wait before they are added up
LEAVES = 1 << 17  # leaves that a partition counts before it gives them away, and that a merging task leaves open

#: A to Z lower-cased; of all other ASCII characters only letters are part of a term.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Trie:
    """A radix trie over bytes: the label of the edge to a node, children by first byte, the number of its leaf or -1."""

    __slots__ = ("label", "kids", "leaf")

    def __init__(self, label: bytes = b""):
        self.label, self.kids, self.leaf = label, {}, -1

    def place(self, term: bytes, new: int) -> int:
        """The number of the term's leaf, which is ``new`` if it wasn't there."""
        node, at = self, 0
        while at < len(term):
            kid = node.kids.get(term[at])
            if kid is None:
                kid = node.kids[term[at]] = Trie(term[at:])
            elif not term.startswith(kid.label, at):
                kid = node._split(kid, next(i for i, b in enumerate(kid.label) if at + i == len(term) or term[at + i] != b))
            node, at = kid, at + len(kid.label)
        if node.leaf < 0:
            node.leaf = new
        return node.leaf

    def _split(self, kid: Trie, length: int) -> Trie:
        upper = Trie(kid.label[:length])
        kid.label = kid.label[length:]
        upper.kids[kid.label[0]] = kid
        self.kids[upper.label[0]] = upper
        return upper

    def terms(self) -> Iterator[tuple[bytes, int]]:
        """Terms and numbers of leaves in the order of the terms' bytes."""
        stack = [(self, b"")]
        while stack:
            node, before = stack.pop()
            term = before + node.label
            if node.leaf >= 0:
                yield term, node.leaf
            stack += [(node.kids[b], term) for b in sorted(node.kids, reverse=True)]


class Counts:
    """A trie whose leaves count, by source, documents and occurrences."""

    def __init__(self):
        self.trie, self.leaves, self.sources, self.parts, self.size = Trie(), 0, {}, [], 0

    def add(self, terms: list[bytes], sizes: np.ndarray, names: list[str], who: np.ndarray, docs: np.ndarray, n: np.ndarray) -> None:
        """Merges terms with ``sizes`` counters each: index of the source in ``names``, documents, occurrences."""
        leaf = np.empty(len(terms), np.int64)
        for i, term in enumerate(terms):
            leaf[i] = at = self.trie.place(term, self.leaves)
            self.leaves += at == self.leaves
        source = np.array([self.sources.setdefault(s, len(self.sources)) for s in names], np.int64)
        self.parts.append((np.repeat(leaf, sizes), source[who], docs, n))
        self.size += len(docs)
        if self.size > COUNTERS:
            self.parts = [self._summed(np.arange(self.leaves))]
            self.size = min(len(self.parts[0][0]), COUNTERS // 2)

    def _summed(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, source, documents and occurrences, one counter for each source of a leaf, ordered by the leaves' places."""
        leaf, source, docs, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        key = place[leaf] * len(self.sources) + source
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        first = order[starts]
        return leaf[first], source[first], np.add.reduceat(docs[order], starts), np.add.reduceat(n[order], starts)

    def ordered(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms in order, where each one's counters begin (and the last ones end), and source, documents, occurrences."""
        found = list(self.trie.terms())
        place = np.empty(self.leaves, np.int64)
        place[[leaf for _, leaf in found]] = np.arange(self.leaves)
        leaf, source, docs, n = self._summed(place)
        return [t for t, _ in found], np.searchsorted(place[leaf], np.arange(self.leaves + 1)), source, docs, n


FRAGMENTS = "lang string, prefix binary, first binary, shared array<int>, tails array<binary>, sizes array<int>, names array<string>, who array<int>, docs array<long>, counts array<long>"
KEPT = "lang string, term string, names array<string>, counts array<long>"
SEEN = "lang string, source string, part string, item string, value long"
_LISTS = {"shared": pa.int32(), "tails": pa.binary(), "sizes": pa.int32(), "names": pa.string(), "who": pa.int32(), "docs": pa.int64(), "counts": pa.int64()}
_FRAGMENTS = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("first", pa.binary()), *[(n, pa.list_(t)) for n, t in _LISTS.items()]])
_SEEN = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _lists(bounds: np.ndarray, values, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def fragments(lang: str, counts: Counts) -> pa.RecordBatch:
    """A trie as rows: at most ``FRAGMENT`` leaves of one prefix each, in order, each term without what it shares with the
    one before it."""
    terms, bounds, source, docs, n = counts.ordered()
    cuts, shared, last = [], [], b""
    for k, term in enumerate(terms):
        if not k or term[:CUT] != last[:CUT] or k - cuts[-1] == FRAGMENT:
            cuts.append(k)
            shared.append(0)
        else:
            most = min(len(last), len(term))
            shared.append(most if last[:most] == term[:most] else next(i for i in range(most) if last[i] != term[i]))
        last = term
    firsts, cuts = [terms[k] for k in cuts], np.array([*cuts, len(terms)])
    tails = pa.array([t[k:] for t, k in zip(terms, shared, strict=True)], pa.binary())
    inside = bounds[cuts]
    # the sources that a fragment has, and the counters' places among them
    of = np.repeat(np.arange(len(firsts)), np.diff(inside))
    used, who = np.unique(of * len(counts.sources) + source, return_inverse=True)
    named = np.searchsorted(used // len(counts.sources), np.arange(len(firsts) + 1))
    names = pa.array(list(counts.sources), pa.string()).take(pa.array(used % len(counts.sources)))
    arrays = [
        pa.array([lang] * len(firsts), pa.string()), pa.array([t[:CUT] for t in firsts], pa.binary()), pa.array(firsts, pa.binary()), _lists(cuts, shared, pa.int32()), _lists(cuts, tails, pa.binary()),
        _lists(cuts, np.diff(bounds), pa.int32()), _lists(named, names, pa.string()), _lists(inside, who - named[of], pa.int32()), _lists(inside, docs, pa.int64()), _lists(inside, n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_FRAGMENTS)


def grouped(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of each language of documents (lang, source, text): the language and its terms as ``Counts.add`` takes them."""
    clean = pa.array([t.translate(_LETTERS) for t in batch.column(2).to_pylist()], pa.binary()).cast(pa.string())
    split = pc.ascii_split_whitespace(clean)
    flat, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    doc = np.repeat(np.arange(len(clean)), sizes)[there]
    coded = flat.filter(pa.array(there)).dictionary_encode()
    if not len(coded):
        return
    lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
    langs, sources, d = lang.dictionary.to_pylist(), source.dictionary.to_pylist(), len(clean)
    # occurrences of a term in a document, then documents and occurrences of a term in a language's source
    pair, n = np.unique(coded.indices.to_numpy().astype(np.int64) * d + doc, return_counts=True)
    term, doc = pair // d, pair % d
    key = (lang.indices.to_numpy()[doc].astype(np.int64) * len(coded.dictionary) + term) * len(sources) + source.indices.to_numpy()[doc]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    docs, n, key = np.diff([*starts, len(key)]), np.add.reduceat(n[order], starts), key[starts]
    of, who = key // len(sources), key % len(sources)
    cuts = np.searchsorted(of // len(coded.dictionary), np.arange(len(langs) + 1))
    for k, name in enumerate(langs):
        part = slice(cuts[k], cuts[k + 1])
        terms, sizes = np.unique(of[part], return_counts=True)
        yield name, coded.dictionary.take(pa.array(terms % len(coded.dictionary))).cast(pa.binary()).to_pylist(), sizes, sources, who[part], docs[part], n[part]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of a partition's documents (lang, source, text)."""
    tries = defaultdict(Counts)

    def given() -> Iterator[pa.RecordBatch]:
        for lang, counts in tries.items():
            if counts.leaves:
                rows = fragments(lang, counts)
                for s in range(0, rows.num_rows, 4096):
                    yield rows.slice(s, 4096)

    for batch in batches:
        for part in split_batch(batch):
            for lang, *terms in grouped(part):
                tries[lang].add(*terms)
            if sum(c.leaves for c in tries.values()) > LEAVES:
                yield from given()
                tries = defaultdict(Counts)
    yield from given()


def _merge(min_docs: int) -> Callable:
    """Fragments, ordered by lang, prefix and first term, become the terms with at least ``min_docs`` documents."""

    def closed(where: tuple, counts: Counts, before: bytes | None = None) -> tuple[list[pa.RecordBatch], Counts]:
        # the kept ones of the terms below `before`, and the trie of the others
        terms, bounds, source, docs, n = counts.ordered()
        done = len(terms) if before is None else bisect_left(terms, before)
        rest, names = Counts(), pa.array(list(counts.sources), pa.string())
        if done < len(terms):
            at = slice(bounds[done], None)
            rest.add(terms[done:], np.diff(bounds[done:]), list(counts.sources), source[at], docs[at], n[at])
        total = np.add.reduceat(docs, bounds[:-1])[:done]
        out, kept = [], np.flatnonzero(total >= min_docs)
        for s in range(0, len(kept), 4096):
            some = kept[s : s + 4096]
            sizes = np.diff(bounds)[some]
            at = np.repeat(bounds[some] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            ends = np.concatenate(([0], np.cumsum(sizes)))
            arrays = [pa.array([where[0]] * len(some), pa.string()), pa.array([terms[k].decode() for k in some], pa.string()), _lists(ends, names.take(pa.array(source[at])), pa.string()), _lists(ends, n[at], pa.int64())]
            out.append(pa.RecordBatch.from_arrays(arrays, names=["lang", "term", "names", "counts"]))
        return out, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, counts = None, Counts()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            leaves, inside, named = (np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(n)).to_numpy()))) for n in ("shared", "who", "names"))
            shared, tails, names = (batch.column(n).flatten().to_pylist() for n in ("shared", "tails", "names"))
            sizes, who, docs, n = (batch.column(c).flatten().to_numpy() for c in ("sizes", "who", "docs", "counts"))
            who = who + np.repeat(named[:-1], np.diff(inside))
            low = 0
            while low < len(keys):
                if keys[low] != where:
                    if counts.leaves:
                        yield from closed(where, counts)[0]
                    where, counts = keys[low], Counts()
                elif counts.leaves > LEAVES:
                    # no later fragment has a term before this one's first
                    out, counts = closed(where, counts, batch.column("first")[low].as_py())
                    yield from out
                high = low + 1
                while high < min(len(keys), low + 64) and keys[high] == where:
                    high += 1
                terms, term = [], b""
                for k in range(leaves[low], leaves[high]):
                    term = term[: shared[k]] + tails[k]
                    terms.append(term)
                at, some = slice(inside[low], inside[high]), slice(named[low], named[high])
                counts.add(terms, sizes[leaves[low] : leaves[high]], names[some], who[at] - named[low], docs[at], n[at])
                low = high
        if counts.leaves:
            yield from closed(where, counts)[0]

    return run


def kept_terms(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Staged lang, term, names and counts (occurrences by source, sources without any left out) of the terms that at
    least ``min_docs`` documents of a language have; ``rows`` have lang, source and text without nulls."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = staged(rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_count, FRAGMENTS), "tries")
    dealt = parts.repartitionByRange(n, "lang", "prefix").sortWithinPartitions("lang", "prefix", "first")
    return staged(dealt.mapInArrow(_merge(min_docs), KEPT), "terms")


def rated(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exactly, whatever the size of the counts."""
    if counts.max(initial=0) > (1 << 62) // SCALE:
        counts, totals = counts.astype(object), totals.astype(object)
    return (1 + (counts + ADDED) * SCALE // (totals + ADDED * terms)).astype(np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pairs of sources and the best terms of each source, of the rows of one language after another.

    A task holds the pairs of one language at a time, of which the result has a row each.
    """
    schema, lang, sums, best, sources = _SEEN, None, None, None, None

    def out() -> Iterator[pa.RecordBatch]:
        for i, source in enumerate(sources):
            pairs = [(s, int(sums[min(i, j), max(i, j)])) for j, s in enumerate(sources) if j != i]
            for part, items in (("pair", pairs), ("term", [(t, -f) for f, t in best[i]])):
                k = len(items)
                if k:
                    arrays = [[lang] * k, [source] * k, [part] * k, *zip(*items, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)] if len(langs) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows = batch.slice(a, b - a)
            if langs[a] != lang:
                if lang is not None:
                    yield from out()
                lang, sources = langs[a], rows.column("sources")[0].as_py()
                sums, best = np.zeros((len(sources), len(sources)), np.int64), [[] for _ in sources]
            terms = rows.column("term").to_pylist()
            counts = rows.column("dense").flatten().to_numpy().reshape(b - a, -1)
            totals, v = np.array(rows.column("totals")[0].as_py(), np.int64), rows.column("v")[0].as_py()
            p = rated(counts, totals, v)
            of_lang = rated(rows.column("n").to_numpy(), np.array(rows.column("n_lang")[0].as_py(), np.int64), v)
            over = p - of_lang[:, None]
            for i in range(len(sources)):
                sums[i, i + 1 :] += np.abs(p[:, i : i + 1] - p[:, i + 1 :]).sum(axis=0)
                at = np.flatnonzero((counts[:, i] > 0) & (over[:, i] > 0))
                if len(at) > TOP:
                    at = at[over[at, i] >= np.partition(over[at, i], len(at) - TOP)[len(at) - TOP]]
                best[i] = heapq.nsmallest(TOP, best[i] + [(-int(over[k, i]), terms[k]) for k in at])
    if lang is not None:
        yield from out()


def diverge(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from the others of its language (part ``pair``,
    all of them), and by which terms it stands out from the language (part ``term``, the first ``TOP``).

    Null text, lang and source are empty; repeated rows are documents of their own; a source whose texts have no term
    counts as one without occurrences; a language without kept terms has pairs of value 0; an empty table gives an empty
    result; other columns are ignored.
    """
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*named)
    with scratch(docs.sparkSession):
        kept = kept_terms(rows, min_docs)
        groups = staged(rows.select("lang", "source").distinct(), "groups")
        each = kept.select("lang", F.explode(F.arrays_zip("names", "counts")).alias("x")).groupBy("lang", F.col("x.names").alias("source")).agg(F.sum("x.counts").alias("n"))
        each = groups.join(each, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("g"))
        langs = each.groupBy("lang").agg(F.sort_array(F.collect_list("g")).alias("gs"), F.sum("g.n").alias("n_lang"))
        langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
        langs = staged(langs.select("lang", F.col("gs.source").alias("sources"), F.col("gs.n").alias("totals"), "n_lang", F.coalesce("v", F.lit(0)).alias("v")), "langs")
        found = F.map_from_arrays("names", "counts")

        def dense(source: Column) -> Column:
            return F.coalesce(F.try_element_at("counted", source), F.lit(0).cast("long"))

        whole = kept.select("lang", "term", found.alias("counted"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).join(limited(langs), "lang")
        seen = whole.select("lang", "term", "n", F.transform("sources", dense).alias("dense"), "sources", "totals", "n_lang", "v").mapInArrow(_compare, SEEN)
        seen = seen.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        bare = langs.filter("v = 0").select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.lit("pair").alias("part"), F.explode("sources").alias("item"), F.lit(0).cast("long").alias("value"))
        every = seen.unionByName(bare.filter("source <> item"))
        place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        return staged(every.withColumn("rank", place).filter((F.col("part") == "pair") | (F.col("rank") <= TOP)), "divergence", kept=True)
