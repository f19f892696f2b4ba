"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

Kernel: two words are alike as far as they share subsequences of ``ORDER`` = 3 characters, each weighed by ``DECAY`` to the
power of the length it spans, gaps included, up to ``SPAN``; so characters put between those of an insult lower its
similarity and don't end it. Kernel values are normalised by those of the words with themselves. Landmarks are
words of the training sample, half of them from toxic texts. The machine is linear in the Nyström features
K(x, Z) K(Z, Z)^(-1/2), so its decision is a weighted sum of K(x, z), which for a kernel with explicit subsequences is
one table of weights by subsequence: a word is scored by the sum of its subsequences' weights over its own norm.

A sentence or text is as toxic as its worst word. The labels are of texts, so training starts from words of toxic texts
with a part that clean texts hardly hold, against random words of clean texts; it fits, adds the worst words of toxic
and of clean texts, and fits again (``ROUNDS`` times). Variants with a character put in train it to tolerate that. Words are lower-case
runs without white space; longer ones than ``LONGEST`` are scored in overlapping windows; runs of up to two characters
in turn are scored joined, too. The logistic function maps the decision to (0, 1), with its 0.3 halfway between the
training texts of both kinds.

The learner sees single words (and joined short ones): an insult split over longer words is not learned.

The fit is bounded: ``SAMPLE`` labelled documents of each kind, those with the least hash of doc_id, never held-out
ones, and of each up to ``BAG`` distinct words, those with the least hash; ``OTHERS`` words drawn from clean texts, ``VARIED``
words with variants and the ``HARD`` worst clean words in each round. Labels, lang, source and doc_id are inputs of no score. Whole
texts are scored, in one pass and without a shuffle; each Python worker keeps the scores of up to ``CACHE_WORDS`` words.

Characters are told apart within any script of up to 44 letters in a row; across scripts they may share a class.

Defined cases: a null or empty text has no words and scores as the least toxic word; a null doc_id is held out never
and joins no label; several labels of a document count as toxic if one is, and of rows that share a doc_id one is learned from; without toxic or without clean training
texts every score is 0; repeated rows are scored as often; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright.plans.columns import pick
from bytewright.plans.scratch import forget
from bytewright.plans.workers import kept
from bytewright.sources.tables import table

NAME = "op4_toxicity"
ORDER, DECAY, SPAN, LONGEST = 3, 0.8, 7, 24
LANDMARKS, ROUNDS, SAMPLE, THRESHOLD = 256, 3, 600, 0.3
BAG, OTHERS, VARIED, HARD = 4000, 3000, 500, 2500
PURE, SLOPE = 20, 4.0  # purity of words first taken as toxic; of the logistic function
CACHE_WORDS = 100_000  # about 15 MB
_CODES = 72  # classes of characters
_EDGES = ".,;:!?\"'()[]*%&$#"

# Every triple of offsets i < j < k from a first character, with its weight.
_TRIPLES = [(j, k, DECAY ** (k + 1)) for k in range(2, SPAN) for j in range(1, k)]


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of all words in one array, and where each word begins (and the end)."""
    words = [f"`{w}{{" for w in words]  # beside a and z: where a word begins and ends
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    latin = (points >= 96) & (points <= 123)
    return np.where(latin, points - 96, 28 + points % (_CODES - 28)), starts


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of every subsequence of three characters in every word, repeats apart."""
    codes, starts = codes_of(words)
    owner = np.repeat(np.arange(len(words)), np.diff(starts))
    ends = starts[1:][owner] if len(words) else owner
    at = np.arange(len(codes))
    found = []
    for j, k, weight in _TRIPLES:
        first = at[at + k < ends]
        found.append((owner[first], (codes[first] * _CODES + codes[first + j]) * _CODES + codes[first + k], np.full(len(first), weight)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Kernel:
    """Sums over subsequences of words: norms and weighted sums."""

    def __init__(self, words: list[str]):
        word, sub, weight = features(words)
        keys, which = np.unique(word * _CODES**3 + sub, return_inverse=True)
        self.n, self.word, self.sub = len(words), keys // _CODES**3, keys % _CODES**3
        self.weight = np.bincount(which, weight, len(keys))
        norm = np.sqrt(np.bincount(self.word, self.weight**2, self.n))
        self.scale = 1 / np.where(norm > 0, norm, 1)

    def against(self, other: Kernel) -> np.ndarray:
        out = np.empty((self.n, other.n))
        for z in range(other.n):
            own = other.word == z
            table = np.zeros(_CODES**3)
            table[other.sub[own]] = other.weight[own] * other.scale[z]
            out[:, z] = self.total(table)
        return out

    def total(self, table: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, self.weight * table[self.sub], self.n) * self.scale


class Model:
    """A weight for each subsequence, and the logistic function of the decision."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, shift: float):
        self.table, self.bias, self.slope, self.shift = table.astype(np.float64), bias, slope, shift

    def decide(self, words: list[str]) -> np.ndarray:
        """Of words without the marks at their ends, and of their letters alone, the larger."""
        bare = [w.strip(_EDGES) or w for w in words]
        out = np.concatenate([np.zeros(0)] + [Kernel(bare[i : i + 2_000]).total(self.table) + self.bias for i in range(0, len(bare), 2_000)])
        mixed = [i for i, w in enumerate(bare) if not w.isalpha() and not any(c.isdigit() or c in "=@/" for c in w)]
        joined = [(i, w) for i in mixed if len(w := "".join(filter(str.isalpha, bare[i]))) > 3]
        if joined:  # characters put between letters
            at = [i for i, _ in joined]
            out[at] = np.maximum(out[at], self.decide([w for _, w in joined]))
        return out

    def score(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (decision - self.shift) + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def words_of(text: str | None) -> list[str]:
    """A text's instances: its words, windows of long ones, and joined runs of words of up to two characters."""
    words = (text or "").lower().split()
    if not words:
        return []
    out = words if max(map(len, words)) <= LONGEST else [p for w in words for p in _windows(w)]
    if min(map(len, words)) > 1:
        return out
    run: list[str] = []
    for w in [*words, "\0" * 3]:
        if len(w) <= 2:
            run.append(w)
        else:
            if len(run) >= 4 and sum(len(x) == 1 for x in run) >= 3:
                out = out + _windows("".join(run))
            run = []
    return out


def _windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _fit(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps; both kinds weigh the same."""
    n, d = x.shape
    x1 = np.hstack([x, np.ones((n, 1))])
    cost = c * np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    w, ridge = np.zeros(d + 1), np.eye(d + 1)
    ridge[d, d] = 1e-3
    for _ in range(steps):
        inside = y * (x1 @ w) < 1
        xi, ci = x1[inside], cost[inside] / n
        new = np.linalg.solve(ridge / n + xi.T @ (ci[:, None] * xi), xi.T @ (ci * y[inside]))
        done = np.abs(new - w).max() < 1e-9
        w = new if done else 0.5 * w + 0.5 * new
        if done:
            break
    return w[:d], float(w[d])


def _parts(word: str) -> set[str]:
    """Substrings by which first picks are made: of 3 to 6 characters, and the word."""
    return {word[i : i + n] for n in range(3, 7) for i in range(len(word) - n + 1)} | {f"^{word}$"}


def _surplus(n_bad: int, n_good: int, all_bad: int, all_good: int) -> float:
    """Log-likelihood ratio of a part that toxic texts hold ``PURE`` times as often as clean ones at least, else 0."""
    share, n = all_bad / (all_bad + all_good), n_bad + n_good
    if n_bad * all_good <= PURE * n_good * all_bad:
        return 0.0
    return 2 * (n_bad * np.log(n_bad / (share * n)) + (n_good * np.log(n_good / ((1 - share) * n)) if n_good else 0.0))


def digest(text: str | None) -> tuple[list[str], list[int]]:
    """What is learned from a text: its distinct words, and marks that near copies share (least hashes of five words)."""
    words = (text or "").lower().split()
    hashes = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))], np.uint64)
    marks = [int(((hashes * np.uint64(m)) % np.uint64(4294967291)).min()) for m in (1, 2654435761, 2246822519, 3266489917, 668265263, 374761393)]
    bag = {w.strip(_EDGES) or w for w in words_of(text)}
    if len(bag) > BAG:
        bag = sorted(bag, key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))[:BAG]
    return sorted(bag), marks


def _without_copies(samples: list[tuple[list[str], list[int], int]]) -> list[tuple[list[str], int]]:
    """One of each group of near copies: copies are no evidence for a word."""
    seen: set[tuple] = set()
    kept = []
    for bag, marks, label in samples:
        own = set(enumerate(marks))
        if not own & seen:
            kept.append((bag, label))
        seen |= own
    return kept


def _worst(bags: list[list[str]], scores: dict[str, float]) -> list[str]:
    return [max(b, key=scores.__getitem__) for b in bags]


def train(samples: list[tuple[list[str], list[int], int]], seed: int = 7) -> Model | None:
    """From digests with their labels; ``None`` without both labels. Every fourth text only serves to place the threshold."""
    bags = _without_copies(samples)
    kinds = [[b for b, y in bags if b and bool(y) == kind] for kind in (True, False)]
    if not all(kinds):
        return None
    (bad, bad_apart), (good, good_apart) = (([b for i, b in enumerate(k) if i % 4 or len(k) < 40], [b for i, b in enumerate(k) if not i % 4 or len(k) < 40]) for k in kinds)
    rng = np.random.default_rng(seed)
    n_bad: Counter = Counter()
    for b in bad:
        n_bad.update({p for w in b for p in _parts(w)})
    n_bad = Counter({p: n for p, n in n_bad.items() if n > 1}) or n_bad
    wanted = {p: p for p in n_bad}  # one string for each part, and tuples of these: both take little memory
    known = lambda w: tuple(wanted[p] for p in _parts(w) if p in wanted)
    parts = {w: known(w) for b in bad for w in b}
    n_good: Counter = Counter()
    of_word: dict[str, tuple[str, ...]] = {}
    for b in good:
        for w in b:
            if w not in of_word:
                of_word[w] = known(w)
        n_good.update({p for w in b for p in of_word[w]})
    worth = {p: _surplus(n_bad[p], n_good[p], len(bad), len(good)) for p in wanted}
    sure = 2 * np.log(len(wanted) + 1)  # more than the luckiest of so many parts would have by chance
    holders: dict[str, set[str]] = {}
    for w, own in parts.items():
        for p in own:
            if worth.get(p, 0.0) >= sure:
                holders.setdefault(p, set()).add(w)
    texts_of: dict[str, set[int]] = {}
    for i, b in enumerate(bad):
        for w in b:
            texts_of.setdefault(w, set()).add(i)
    alike = {w: max((worth.get(p, 0.0) for p in own), default=0.0) for w, own in parts.items() if w not in of_word or worth.get(f"^{w}$", 0.0)}
    positive: set[str] = set()
    while holders:  # the strongest part, longest on ties, takes its words; the others must be strong without these
        now = {p: _surplus(len(set().union(*(texts_of[w] for w in ws))), n_good[p], len(bad), len(good)) for p, ws in holders.items()}
        p = max(now, key=lambda p: (now[p], len(p), p))
        if now[p] < sure:
            break
        taken = holders.pop(p)
        positive |= taken & alike.keys()
        holders = {q: left for q, ws in holders.items() if now[q] >= sure and (left := ws - taken)}
    if not positive:
        positive = {max(own, key=alike.__getitem__) for b in bad if (own := [w for w in b if alike.get(w, 0.0)])} or {b[0] for b in bad}
    common = sorted(of_word)
    of_word.clear()
    hard: set[str] = set()
    for _ in range(ROUNDS):
        other = [common[i] for i in rng.choice(len(common), min(len(common), OTHERS), replace=False)]
        yes = sorted(positive)
        yes += [w[:i] + chr(97 + c) + w[i:] for w in yes[:VARIED] if len(w) > 4 for i, c in zip(rng.integers(1, len(w), 2), rng.integers(0, 26, 2), strict=True)]
        no = sorted((set(other) | hard) - positive)
        first = lambda words, n: [words[i] for i in rng.choice(len(words), min(len(words), n), replace=False)]
        tough = sorted(hard - positive) or no
        marks = Kernel(first(yes, LANDMARKS // 2) + first(tough, LANDMARKS // 4) + first(no, LANDMARKS // 4))
        values, vectors = np.linalg.eigh(marks.against(marks))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        y = np.concatenate([np.ones(len(yes)), -np.ones(len(no))])
        w, bias = _fit(Kernel(yes + no).against(marks) @ root, y)
        model = Model(np.bincount(marks.sub, marks.weight * (root @ w * marks.scale)[marks.word], _CODES**3), bias, SLOPE, 0.0)
        scores = dict(zip(common, model.decide(common).tolist(), strict=True))
        hard |= set(sorted({w for b in good for w in sorted(b, key=lambda x: (-scores[x], x))[:2]}, key=lambda x: (-scores[x], x))[:HARD])
        new = sorted(set(parts) - scores.keys())
        scores.update(zip(new, model.decide(new).tolist(), strict=True))
        positive |= {x for x in _worst(bad, scores) if scores[x] > 0.5 and alike.get(x, 0.0) >= sure / 2}
    apart = sorted({w for b in bad_apart + good_apart for w in b} - scores.keys())
    scores.update(zip(apart, model.decide(apart).tolist(), strict=True))
    of_bad, of_good = (np.sort([max(map(scores.__getitem__, b)) for b in group]) for group in (bad_apart, good_apart))
    cuts = np.unique(np.concatenate([of_bad, of_good]))
    wrong = np.searchsorted(of_bad, cuts, "right") / len(of_bad) + (len(of_good) - np.searchsorted(of_good, cuts, "right")) / len(of_good)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    above = cuts[min(best[-1] + 1, len(cuts) - 1)]
    model.shift = float(cuts[best[0]] + above) / 2
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[list[str], list[int], int]]:
    """The digests and labels of up to ``sample`` documents of each label, without held-out ones."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = None
    for label in (0, 1):
        some = marked.where((F.col("toxic") != 0) == bool(label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = some if drawn is None else drawn.unionByName(some)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                bags, marks = zip(*map(digest, part.column("text").to_pylist()), strict=True)
                kinds = pa.list_(pa.string()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(bags, kinds[0]), pa.array(marks, kinds[1])], ["doc_id", "toxic", "bag", "marks"])

    texts = docs.where(~held_out(F.col("doc_id"))).join(F.broadcast(drawn), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic"), "text")
    rows = texts.mapInArrow(digests, "doc_id long, toxic long, bag array<string>, marks array<long>")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("bag", "marks", "toxic")).alias("x")).orderBy("doc_id").collect()
    return [(r.x.bag, r.x.marks, int(r.x.toxic != 0)) for r in one]


def score_documents(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with doc_id and text to the columns ``keep``, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = b"" if model is None else model.table.tobytes()
        known = kept((NAME, mark), dict)
        least = -1e9
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [words_of(t) for t in part.column("text").to_pylist()]
                if model is None:
                    scores = np.zeros(len(found))
                else:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    new = list({w for words in found for w in words if w not in known})
                    known.update(zip(new, model.decide(new).tolist(), strict=True))
                    scores = model.score(np.array([max(map(known.__getitem__, words), default=least) for words in found]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), part.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))],
                    [*keep, "held_out", "score", "predicted"],
                )

    rows = docs.select(*keep, *(c for c in ("text",) if c not in keep), held_out(F.col("doc_id")).alias("held_out"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return rows.mapInArrow(run, f"{kinds}, held_out boolean, score double, predicted int")


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    model = train(training_sample(pick(docs, "doc_id", "text"), pick(labels, "doc_id", "toxic")))
    forget(docs.sparkSession)  # the sample's memory
    return model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labelled ones that are not held out."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return score_documents(docs.withColumn("doc_id", F.col("doc_id").cast("long")), fitted(docs, table(spark, sf_dir, "labels")))
