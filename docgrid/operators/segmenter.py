"""Words of CJK text by a unigram model that the corpus teaches.

Every run of CJK characters is a lattice of candidate words; its words are the path of highest probability.  The
vocabulary is learned by expectation maximisation: substrings that recur are candidates, Spark counts how often each is
expected on the paths of all distinct runs, and every round the words leave that the corpus would miss least.  A tokenizer
is a column function, so searches and indexes take it in place of single characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.operators.staging import cut, packed, unpacked

RUN = r"[\x{4e00}-\x{9fff}]+"
PARTS = re.compile("[a-z0-9À-ɏ]+|[一-鿿]+")
LONGEST = 4  # characters of a word
WORDS = 50_000  # words of a vocabulary at most, single characters apart (of which there are 20,992)
SEEDS = 10  # candidates for each of these words at the beginning
RARE = 2  # occurrences below which a substring is no candidate, and expected ones below which a word leaves
ROUNDS = 8
BLOCK = 1 << 18  # places of the runs that are looked at together
TABLE = 1 << 22  # cells of a table of states and characters at most
COUNTED = 1 << 21  # characters whose substrings are counted together
UNSEEN = -30.0  # logarithm of a character's probability that no text has shown


def _ways(run: str, score: dict[str, float], longest: int) -> list[list[tuple[int, float]]]:
    """For each place of a run the words that end there: where they begin, and their logarithm."""
    out: list[list[tuple[int, float]]] = [[]]
    for end in range(1, len(run) + 1):
        here = [(begin, score[run[begin:end]]) for begin in range(max(0, end - longest), end) if run[begin:end] in score]
        if not here or here[-1][0] != end - 1:
            here.append((end - 1, UNSEEN))
        out.append(here)
    return out


def best_path(run: str, score: dict[str, float], longest: int = LONGEST) -> list[str]:
    """The most probable words of a run; of equal paths the one with fewer words, then with the longer last word."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end, words in enumerate(_ways(run, score, longest)[1:], 1):
        best.append(max(((best[b][0] + s, best[b][1] - 1, -b) for b, s in words)))
    out, end = [], len(run)
    while end:
        begin = -best[end][2]
        out.append(run[begin:end])
        end = begin
    return out[::-1]


def expected(run: str, score: dict[str, float], longest: int = LONGEST) -> dict[str, float]:
    """How often each word is expected in a run, over all its segmentations, by forward and backward sums."""

    def total(a: list[float]) -> float:
        top = max(a)
        return top + math.log(sum(math.exp(x - top) for x in a))

    ways, n = _ways(run, score, longest), len(run)
    ahead, back = [0.0] * (n + 1), [[] for _ in range(n + 1)]
    for end in range(1, n + 1):
        ahead[end] = total([ahead[b] + s for b, s in ways[end]])
    behind = [0.0] * (n + 1)
    back[n] = [0.0]
    for end in range(n, 0, -1):
        behind[end] = total(back[end])
        for b, s in ways[end]:
            back[b].append(behind[end] + s)
    out: Counter = Counter()
    for end in range(1, n + 1):
        for b, s in ways[end]:
            out[run[b:end]] += math.exp(ahead[b] + s + behind[end] - ahead[n])
    return out


class Lattices:
    """Words as a trie of numbered prefixes, and the lattices of many runs at once as arrays over their characters.

    Runs of like lengths are a block, of ``BLOCK`` places at most unless one run has more; a step along the runs is one
    operation on all runs of the block.
    """

    def __init__(self, score: dict[str, float], longest: int):
        ids = {"": 0}
        for word in score:
            for k in range(1, min(len(word), longest) + 1):
                ids.setdefault(word[:k], len(ids))
        #: The word of each state; what is a prefix only has the score -inf.
        self.words, self.longest = list(ids), longest
        self.score = np.array([score.get(w, -np.inf) if w else -np.inf for w in self.words])
        edges = np.array([ids[w[:-1]] << 16 | ord(w[-1]) for w in self.words[1:]], np.int64)
        order = np.argsort(edges)
        self.edges, self.to = np.append(edges[order], np.iinfo(np.int64).max), np.append(order + 1, 0)
        # characters are numbered from 1; where that is small, each state's next ones are a row of a table
        known = np.unique(edges & 0xFFFF)
        self.letter, self.table = np.zeros(1 << 16, np.int64), None
        self.letter[known] = np.arange(1, len(known) + 1)
        if len(self.words) * (len(known) + 1) <= TABLE:
            self.table = np.full((len(self.words), len(known) + 1), -1, np.int32)
            self.table[edges >> 16, self.letter[edges & 0xFFFF]] = np.arange(1, len(self.words))

    def _next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return np.where((state >= 0) & (code >= 0), self.table[state, self.letter[code]], -1)
        edge = state << 16 | code
        at = np.searchsorted(self.edges, edge)
        return np.where((state >= 0) & (code >= 0) & (self.edges[at] == edge), self.to[at], -1)

    def blocks(self, runs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """Numbers of the runs of a block, the longest first, their lengths, their codes (a row a place), and for each
        length of a word the states and scores of the words that begin at each place."""
        size = np.array([len(r) for r in runs], np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        while len(order):
            here, order = np.split(order, [max(1, BLOCK // int(size[order[0]]))])
            n, most = size[here], int(size[here[0]])
            code = np.full((most + self.longest, len(here)), -1, np.int64)
            flat = np.frombuffer("".join([runs[i] for i in here.tolist()]).encode("utf-16-le"), np.uint16)
            run = np.repeat(np.arange(len(here)), n)
            code[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), run] = flat
            state, states, scores = np.zeros((most, len(here)), np.int64), [], []
            for k in range(self.longest):
                now = code[k : most + k]
                state = self._next(state, now)
                said = np.where(state >= 0, self.score[state], -np.inf)
                states.append(state)
                scores.append(np.where((said == -np.inf) & (now >= 0), UNSEEN, said) if k == 0 else said)
            yield here, n, code, states, scores

    def _shares(self, n: np.ndarray, scores: list[np.ndarray]) -> list[np.ndarray]:
        """For each length of a word the share of a run's segmentations, by probability, that have it at each place."""
        most, wide = int(n[0]), len(n)
        going = np.searchsorted(-n, -np.arange(most), side="left")  # runs longer than a place
        alone = scores[0][scores[0] > -np.inf]
        if alone.min() < -400 / self.longest:
            return self._shares_by_logarithms(n, scores, going)
        said = [np.exp(s) for s in scores]
        # sums over the ways to a place are kept as their ratio to those to the place before: of at most `longest` ratios
        # that follow each other, no product is beyond what a number can hold, as no single character is less probable
        ratio = np.ones((most + self.longest, wide))
        for end in range(1, most + 1):
            g = going[end - 1]
            sums, over = said[0][end - 1, :g].copy(), np.ones(g)
            for k in range(2, min(self.longest, end) + 1):
                over = over * ratio[end - k, :g]
                sums += said[k - 1][end - k, :g] / over
            ratio[end - 1, :g] = sums
        over = np.ones((most, wide))
        for k in range(self.longest):
            over = over * ratio[k : most + k]
            said[k] /= over
        behind = np.zeros((most + self.longest, wide))
        behind[n, np.arange(wide)] = 1.0
        for begin in range(most - 1, -1, -1):
            g = going[begin]
            behind[begin, :g] = sum(behind[begin + k, :g] * said[k - 1][begin, :g] for k in range(1, self.longest + 1))
        return [s * behind[k : most + k] for k, s in enumerate(said, 1)]

    def _shares_by_logarithms(self, n: np.ndarray, scores: list[np.ndarray], going: np.ndarray) -> list[np.ndarray]:
        """``_shares`` where characters are too improbable for products."""
        most, wide = int(n[0]), len(n)

        def total(ways: list[np.ndarray]) -> np.ndarray:
            top = reduce(np.maximum, ways)
            safe = np.where(top == -np.inf, 0.0, top)
            return np.log(sum(np.exp(w - safe) for w in ways)) + safe

        with np.errstate(divide="ignore"):
            ahead = np.full((most + 1, wide), -np.inf)
            ahead[0] = 0.0
            for end in range(1, most + 1):
                g = going[end - 1]
                ahead[end, :g] = total([ahead[end - k, :g] + scores[k - 1][end - k, :g] for k in range(min(self.longest, end), 0, -1)])
            behind = np.full((most + self.longest, wide), -np.inf)
            behind[n, np.arange(wide)] = 0.0
            for begin in range(most - 1, -1, -1):
                g = going[begin]
                behind[begin, :g] = total([behind[begin + k, :g] + scores[k - 1][begin, :g] for k in range(1, self.longest + 1)])
        whole = ahead[n, np.arange(wide)]
        return [np.exp(ahead[:most] + s + behind[k : most + k] - whole) for k, s in enumerate(scores, 1)]

    def expected(self, runs: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the word of each state is expected in the runs, each ``times`` over, and each character that is no word."""
        out, unseen = np.zeros(len(self.words)), np.zeros(1 << 16)
        for here, n, code, states, scores in self.blocks(runs):
            for k, share in enumerate(self._shares(n, scores)):
                some = scores[k] > -np.inf
                x, state = (share * times[here])[some], states[k][some]
                known = (state >= 0) & (self.score[state] > -np.inf)
                out += np.bincount(state[known], x[known], len(out))
                if k == 0:
                    unseen += np.bincount(code[: len(some)][some][~known], x[~known], len(unseen))
        return out, unseen

    def best(self, runs: list[str]) -> list[list[str]]:
        """``best_path`` of each run."""
        out: list[list[str]] = [[] for _ in runs]
        for here, n, _, _, scores in self.blocks(runs):
            most, wide = int(n[0]), len(here)
            going = np.searchsorted(-n, -np.arange(most), side="left")
            best, count, last = np.zeros((most + 1, wide)), np.zeros((most + 1, wide), np.int64), np.ones((most + 1, wide), np.int64)
            for end in range(1, most + 1):
                g = going[end - 1]
                b, c, at = best[end - 1, :g] + scores[0][end - 1, :g], count[end - 1, :g] + 1, np.ones(g, np.int64)
                for k in range(2, min(self.longest, end) + 1):
                    s, w = best[end - k, :g] + scores[k - 1][end - k, :g], count[end - k, :g] + 1
                    # of equal paths the one with fewer words, then the longer last word
                    wins = (s > b) | ((s == b) & (w <= c))
                    b, c, at = np.where(wins, s, b), np.where(wins, w, c), np.where(wins, k, at)
                best[end, :g], count[end, :g], last[end, :g] = b, c, at
            ends, place, of = np.zeros((wide, most + 1), bool), n.copy(), np.arange(wide)
            while len(of):
                ends[of, place] = True
                place = place - last[place, of]
                of, place = of[place > 0], place[place > 0]
            run, end = np.nonzero(ends)
            end, first = end.tolist(), np.searchsorted(run, np.arange(wide + 1)).tolist()
            for k, i in enumerate(here.tolist()):
                cuts, said = end[first[k] : first[k + 1]], runs[i]
                out[i] = [said[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out


def substrings(runs: list[str], times: np.ndarray, longest: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """For each length up to ``longest`` the substrings of the runs, and how often each occurs, each run ``times`` over."""
    said = "".join(runs)
    size = np.array([len(r) for r in runs], np.int64)
    code = np.frombuffer(said.encode("utf-16-le"), np.uint16).astype(np.int64)
    left, n = np.repeat(np.cumsum(size), size) - np.arange(len(code)), np.repeat(times, size)  # characters to the end of the run
    at, number = np.arange(len(code)), np.zeros(len(code), np.int64)
    for k in range(1, longest + 1):
        # a substring is the number of its beginning, and its last character
        long = left[at] >= k
        at, number = at[long], number[long]
        if not len(at):
            return
        _, first, number = np.unique(number << 16 | code[at + k - 1], return_index=True, return_inverse=True)
        yield [said[i : i + k] for i in at[first].tolist()], np.bincount(number, n[at]).astype(np.int64)


def _count(longest: int):
    """(word, n) of the substrings of runs, counted over ``COUNTED`` characters together."""

    def counted(runs: list[str], times: list[int]) -> Iterator[pa.RecordBatch]:
        for words, n in substrings(runs, np.array(times, np.int64), longest):
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n)], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, times, size = [], [], 0
        for batch in unpacked(batches):
            for r, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs.append(r)
                times.append(n)
                size += len(r)
                if size >= COUNTED:
                    yield from counted(runs, times)
                    runs, times, size = [], [], 0
        yield from counted(runs, times)

    return run


def _expect(lattices: Lattices):
    """(state, n) of what ``Lattices.expected`` gives; characters that are no word have the states below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unseen = np.zeros(len(lattices.words)), np.zeros(1 << 16)
        for batch in unpacked(batches):
            x, y = lattices.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64))
            words, unseen = words + x, unseen + y
        at, alone = np.flatnonzero(words), np.flatnonzero(unseen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, -alone))), pa.array(np.concatenate((words[at], unseen[alone])))], ["state", "n"])

    return run


def _scores(rows: list, least: float = 0.0) -> dict[str, float]:
    kept = {r["word"]: float(r["n"]) for r in rows if r["n"] > 0 and (len(r["word"]) == 1 or r["n"] >= least)}
    whole = math.log(sum(kept.values())) if kept else 0.0
    return {w: math.log(n) - whole for w, n in kept.items()}


def _missed(score: dict[str, float], rows: list, keep: int, longest: int) -> set[str]:
    """The longer words that the corpus would miss least beyond the first ``keep``: how often a word is expected, times
    what its best other path costs."""
    n = {r["word"]: r["n"] for r in rows}
    loss = {}
    for word in [w for w in score if len(w) > 1]:
        others = _Without(score, word)
        loss[word] = n[word] * (score[word] - sum(others.get(w, UNSEEN) for w in best_path(word, others, longest)))
    return set(sorted(loss, key=lambda w: (-loss[w], w))[keep:])


class _Without:
    """Scores without one word."""

    def __init__(self, score: dict[str, float], word: str):
        self.score, self.word = score, word

    def __contains__(self, word: str) -> bool:
        return word != self.word and word in self.score

    def __getitem__(self, word: str) -> float:
        return self.score[word]

    def get(self, word: str, default: float) -> float:
        return self.score[word] if word in self else default


def learn(docs: DataFrame, text: str = "text", words: int = WORDS, longest: int = LONGEST, rounds: int = ROUNDS) -> dict[str, float]:
    """Words with the logarithms of their probabilities: single characters, and at most ``words`` longer ones.

    The driver holds the candidates, ``SEEDS`` times ``words`` at most, and their counts.  Equal runs are counted once, times
    their number; null texts have none; a corpus without CJK characters has no words.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(RUN), F.lit(0))).alias("run"))
    runs = packed(runs.groupBy("run").agg(F.count("*").alias("n")))
    counted = cut(runs.mapInArrow(_count(longest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter((F.length("word") == 1) | (F.col("n") >= RARE)))
    single, several = counted.filter(F.length("word") == 1).collect(), counted.filter(F.length("word") > 1)
    score = _scores(single + several.orderBy(F.desc(F.col("n") * F.length("word")), "word").limit(SEEDS * words).collect())
    for left in range(rounds if score else 0, 0, -1):
        lattices = Lattices(score, longest)
        found = runs.mapInArrow(_expect(lattices), "state long, n double").groupBy("state").agg(F.sum("n").alias("n")).collect()  # as many rows as there are words
        found = [{"word": lattices.words[r["state"]] if r["state"] > 0 else chr(-r["state"]), "n": r["n"]} for r in found]
        score = _scores(found, RARE)
        many = sum(len(w) > 1 for w in score)
        # down to `words` by the last round but one, by the same factor each time
        keep = words if left <= 2 else int(many * (words / many) ** (1 / (left - 1))) if many > words else many
        gone = _missed(score, found, keep, longest)
        if gone:
            score = _scores([r for r in found if r["word"] not in gone], RARE)
    return score


def tokenizer(score: dict[str, float], longest: int = LONGEST) -> Callable[[Column], Column]:
    """A column function: lower-case words of letters and digits, and the words of CJK runs, in order."""

    lattices = Lattices(score, longest)

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        parts = [PARTS.findall((text or "").lower()) for text in texts]
        runs = list({part for said in parts for part in said if part[0] >= "一"})
        words = dict(zip(runs, lattices.best(runs), strict=True))
        return pd.Series([[w for part in said for w in words.get(part, (part,))] for said in parts], index=texts.index, dtype=object)

    return tokens
