"""Toxicity by weak supervision.

1. Word and word-stem lists are induced from training labels, a bounded sample.
2. Twelve voters (lexicons and patterns) look at every whole text.
3. A generative label model explains the vote patterns of all documents by a
   hidden class: each voter has an accuracy, and voters depend on one other
   voter each (the tree of largest conditional mutual information), which
   holds their correlations.  It is fitted by expectation maximisation on the
   counts of vote patterns, of which there are at most 2 ** 12.
4. A linear classifier is trained on the model's posterior labels of a bounded
   sample of all rows outside the held-out quarter, with a label or without.

Labels induce the lists and say which class is the toxic one; the posteriors
and the classifier see votes only.  Scores never use labels, lang, source or doc_id.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.llm.common import need, small_batches, stored

#: Labelled rows that the lexicon is induced from at most, rows that the classifier is trained on at most,
#: and induced lexicon entries at most.
SAMPLE_ROWS = 20_000
LEXICON_SIZE = 4_000
THRESHOLD = 0.3
VOTERS = 12

# Common insults of four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown jerk fool"
    " ugly hate shut freak creep crap damn bastard asshole bitch shit fuck fucking"
    " idiota estupido estúpido imbecil imbécil basura asqueroso patético inútil payaso mierda puta cabrón"
    " idiote crétin imbécile stupide ordure dégoûtant pathétique minable clown connard merde salope"
    " dumm dummkopf trottel abschaum müll erbärmlich wertlos widerlich arschloch scheiße hure depp".split()
)
_SHOUT = re.compile(r"!{2,}|\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b")
_DIRECT = re.compile(r"(?i)\b(?:you(?:'re| are)|tu es|eres un|du bist|vous êtes|ihr seid)\b")
_TOKEN = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features_of(text: str) -> Counter:
    """Counts of words (two letters and more) and of their stems of 4 and 5 letters."""
    words = Counter(_TOKEN.findall(text.lower()))
    out = Counter()
    for w, n in words.items():
        if len(w) < 2:
            continue
        out[w] += n
        if len(w) > 4:
            out["4:" + w[:4]] += n
        if len(w) > 5:
            out["5:" + w[:5]] += n
    return out


@dataclass
class Lexicon:
    """Induced entries with their log odds; index is the feature's number."""

    entries: list[str] = field(default_factory=list)
    odds: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.index = {e: i for i, e in enumerate(self.entries)}
        # Word and stem lists by their own keys, so that a text's words are looked up once each.
        self.four = {e[2:]: i for e, i in self.index.items() if e.startswith("4:")}
        self.five = {e[2:]: i for e, i in self.index.items() if e.startswith("5:")}
        self.word = {e: i for e, i in self.index.items() if ":" not in e}
        self.strong = [o >= 4.0 for o in self.odds]
        self.group = [zlib.crc32(e.encode()) % 3 for e in self.entries]


def induce(train: DataFrame) -> Lexicon:
    """Entries that toxic training rows have far more often, counted by document.

    The count is a Spark aggregation; at most LEXICON_SIZE entries come back.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pos, all_ = Counter(), Counter()
            for text, y in zip(b["text"], b["toxic"], strict=True):
                f = features_of(text)
                all_.update(f.keys())
                if y:
                    pos.update(f.keys())
            yield pd.DataFrame({"entry": list(all_), "pos": [pos[e] for e in all_], "n": list(all_.values())})

    totals = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    if not totals["p"] or totals["p"] == totals["n"]:
        return Lexicon()
    n_pos, n_neg = totals["p"], totals["n"] - totals["p"]
    counts = train.select("text", "toxic").mapInPandas(count, "entry string, pos long, n long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    odds = F.log((F.col("pos") + 0.5) / n_pos) - F.log((F.col("n") - F.col("pos") + 0.5) / n_neg)
    best = counts.filter("pos >= 4").withColumn("odds", odds).filter("odds >= 1.5").withColumn("rank", F.col("odds") * F.sqrt("pos")).orderBy(F.desc("rank"), "entry").limit(LEXICON_SIZE)
    rows = best.select("entry", "odds").collect()
    return Lexicon([r["entry"] for r in rows], [r["odds"] for r in rows])


def votes_of(text: str, lex: Lexicon) -> tuple[int, list[int], list[int], float]:
    """Vote mask, lexicon entries hit, their counts and the share of words that hit."""
    words = Counter(_TOKEN.findall(text.lower()))
    n = sum(words.values())
    hits, insults, hit_words = Counter(), 0, 0
    word, four, five = lex.word, lex.four, lex.five
    for w, c in words.items():
        found = [i for i in (word.get(w), four.get(w[:4]) if len(w) > 4 else None, five.get(w[:5]) if len(w) > 5 else None) if i is not None]
        for i in found:
            hits[i] += c
        hit_words += c * any(lex.strong[i] for i in found)
        insults += c * (w in INSULTS)
    strong = [i for i in hits if lex.strong[i]]
    words_hit = [i for i in strong if ":" not in lex.entries[i]]
    weak = [i for i in hits if not lex.strong[i]]
    share = hit_words / n if n else 0.0
    fired = [
        insults > 0,
        *(any(lex.group[i] == g for i in words_hit) for g in range(3)),
        any(lex.entries[i].startswith("4:") for i in strong),
        any(lex.entries[i].startswith("5:") for i in strong),
        sum(hits[i] for i in weak if ":" not in lex.entries[i]) >= 2,
        sum(hits[i] for i in weak if ":" in lex.entries[i]) >= 3,
        share >= 0.005,
        hit_words >= 2,
        _SHOUT.search(text) is not None,
        _DIRECT.search(text) is not None,
    ]
    order = sorted(hits)
    return sum(1 << k for k, x in enumerate(fired) if x), order, [hits[i] for i in order], share


VOTED = "doc_id long, held_out boolean, votes int, entries array<int>, counts array<int>, share double"


def vote(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Votes and lexicon hits of every whole text (null: empty)."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([votes_of(t, lex) for t in b["text"]], columns=["votes", "entries", "counts", "share"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"]}).join(out)

    return rows.mapInPandas(run, VOTED)


class LabelModel:
    """Hidden class, voter accuracies and a tree of dependencies between voters."""

    def __init__(self, masks: np.ndarray, counts: np.ndarray, start: np.ndarray | None = None, rounds: int = 40):
        """masks: distinct vote patterns; counts: rows that have them; start: a first guess of their class."""
        self.bits = (masks[:, None] >> np.arange(VOTERS)) & 1
        self.masks, self.counts = masks, np.asarray(counts, float)
        # Without a guess, class 1 is the one in which more voters fire.
        q = 1 / (1 + np.exp(-(self.bits.sum(1) - 3.0))) if start is None else start
        self.parent = np.full(VOTERS, -1)
        for k in range(rounds):
            mass = np.stack([counts * (1 - q), counts * q], 1)
            if k % 5 == 0:
                self._tree(mass)
            self._fit(mass)
            q = self.posterior(masks)

    def _tree(self, mass: np.ndarray) -> None:
        """The spanning tree of largest mutual information between voters given the class."""
        info = np.zeros((VOTERS, VOTERS))
        x = self.bits
        n = mass.sum() + 1e-9
        for y in (0, 1):
            m, ny = mass[:, y], mass[:, y].sum() + 1e-9
            for a in (0, 1):
                for b in (0, 1):
                    joint = ((x == a) * m[:, None]).T @ (x == b) + 0.01
                    pa, pb = ((x == a) * m[:, None]).sum(0) + 0.02, ((x == b) * m[:, None]).sum(0) + 0.02
                    info += joint / n * np.log(joint * (ny + 0.04) / np.outer(pa, pb))
        inside, self.parent, self.order = [0], np.full(VOTERS, -1), [0]
        while len(inside) < VOTERS:
            rest = [j for j in range(VOTERS) if j not in inside]
            i, j = max(((i, j) for i in inside for j in rest), key=lambda p: (info[p], -p[1]))
            self.parent[j] = i
            inside.append(j)
        self.information = info

    def _fit(self, mass: np.ndarray) -> None:
        self.prior = (mass.sum(0) + 1) / (mass.sum() + 2)
        self.table = np.zeros((VOTERS, 2, 2))  # voter, parent's vote, class: chance to fire
        for j in range(VOTERS):
            above = self.bits[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(self.bits), int)
            for a in (0, 1):
                m = mass * (above == a)[:, None]
                base = ((mass * self.bits[:, [j]]).sum(0) + 0.5) / (mass.sum(0) + 1)
                self.table[j, a] = ((m * self.bits[:, [j]]).sum(0) + 2 * base) / (m.sum(0) + 2)

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """Probability of class 1 for vote masks."""
        bits = (np.asarray(masks)[:, None] >> np.arange(VOTERS)) & 1
        log = np.tile(np.log(self.prior), (len(bits), 1))
        for j in range(VOTERS):
            above = bits[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(bits), int)
            p = self.table[j][above]
            log += np.log(np.where(bits[:, [j]] == 1, p, 1 - p))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))

    def accuracies(self) -> np.ndarray:
        """Of each voter, the chance that its vote on a document equals the class; a pattern counts by its documents."""
        q, n = self.posterior(self.masks), max(self.counts.sum(), 1e-9)
        return np.array([((q * b + (1 - q) * (1 - b)) * self.counts).sum() / n for b in self.bits.T])


def fit_label_model(voted: DataFrame, sample: DataFrame) -> LabelModel:
    """Fit on the vote patterns of all documents; sample (doc_id, toxic) only says which class to begin from for a pattern."""
    marked = voted.select("doc_id", "votes").join(F.broadcast(sample.select(F.col("doc_id").alias("known_id"), F.col("toxic").cast("int").alias("y"))), F.col("doc_id") == F.col("known_id"), "left")
    rows = marked.groupBy("votes").agg(F.count("*").alias("n"), F.count("y").alias("known"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).orderBy("votes").collect()
    masks, n, known, toxic = (np.array([r[c] for r in rows] or [0], float) for c in ("votes", "n", "known", "toxic"))
    masks = masks.astype(int)
    if not toxic.sum() or toxic.sum() == known.sum():
        return LabelModel(masks, n)
    votes = ((masks[:, None] >> np.arange(VOTERS)) & 1).sum(1)
    # Patterns that no labelled row has begin from the number of their votes.
    guess = 1 / (1 + np.exp(-(votes - 3.0)))
    return LabelModel(masks, n, (toxic + guess) / (known + 1))


@dataclass
class Linear:
    """Weights of votes, of the hit share and of lexicon entries, with a bias."""

    weights: np.ndarray
    bias: float


def _columns(votes: int, entries, counts, share: float) -> tuple[np.ndarray, np.ndarray]:
    fired = [k for k in range(VOTERS) if votes >> k & 1]
    idx = np.array([*fired, VOTERS, *(VOTERS + 1 + np.asarray(entries, int))], int)
    val = np.array([*[1.0] * len(fired), min(1.0, 20 * share), *np.log1p(np.asarray(counts, float))])
    return idx, val


def train_linear(rows: list, targets: np.ndarray, n_entries: int, rounds: int = 300, l2: float = 1.0) -> Linear:
    """Logistic regression with soft targets by accelerated gradient descent."""
    dim = VOTERS + 1 + n_entries
    if not rows:
        return Linear(np.zeros(dim), -3.0)
    parts = [_columns(r["votes"], r["entries"], r["counts"], r["share"]) for r in rows]
    where = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    idx, val = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    w, n = np.zeros(dim + 1), len(parts)
    first, second = np.zeros(dim + 1), np.zeros(dim + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(where, w[idx] * val, n) + w[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - targets
        g = np.append(np.bincount(idx, r[where] * val, dim) + l2 * w[:-1], r.sum()) / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Linear(w[:-1], float(w[-1]))


def training_rows(voted: DataFrame, most: int) -> list:
    """At most so many rows outside the held-out quarter, in the order of a hash of the row; equal rows of one doc_id count once."""
    own = voted.filter("not held_out").select("votes", "entries", "counts", "share", F.xxhash64("doc_id", "votes", "entries", "counts").alias("h"))
    different = own.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    # About twice as many as needed are looked at.
    some = own.filter(F.pmod("h", F.lit(1 << 30)) < F.lit(int(min(1.0, 2 * most / max(1, different)) * (1 << 30)))).dropDuplicates(["h"])
    return some.orderBy("h").limit(most).drop("h").collect()


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and votes, one row for each row of docs.

    Lists are induced from at most sample_rows labelled rows (in the order of
    a hash of doc_id) and the classifier is trained on at most sample_rows
    rows, all outside the held-out quarter.  Null and empty texts have no
    votes and get the score of such texts; repeated rows each get a row;
    without documents the result is empty, and without labels the fixed
    lexicon and patterns alone vote.  Other columns are not read.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "toxic")
    small_batches(docs.sparkSession)
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = stored(sample)
    known = F.broadcast(sample.select(F.col("doc_id").alias("known_id"), "toxic"))
    train = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("known_id")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    lex = induce(train)
    voted = stored(vote(docs, lex))
    model = fit_label_model(voted, sample)
    rows = training_rows(voted, sample_rows)
    linear = train_linear(rows, model.posterior(np.array([r["votes"] for r in rows] or [0], int)), len(lex.entries)) if rows else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if linear is None:
                p = model.posterior(b["votes"].to_numpy(int))
            else:
                cols = (_columns(*r) for r in zip(b["votes"], b["entries"], b["counts"], b["share"], strict=True))
                z = np.array([float(linear.weights[i] @ v) + linear.bias for i, v in cols])
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": p, "predicted": (p >= THRESHOLD).astype("int32"), "votes": b["votes"]})

    return voted.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, votes int")
