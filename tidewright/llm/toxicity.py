"""Toxicity by a weighted finite-state pattern grammar over clauses.

Insults are accepted by a weighted automaton of word stems: fixed ones, and stems learned
from labelled documents by their likelihood ratio. A clause is read as symbols: the roles of
each word, quotation marks, and the end of each word. Four small transducers rewrite them:
negation marks what stands a few words after a negation, reported speech marks what follows a
verb of saying or stands in quotation marks, target raises a clause that names one, and threat
turns a threat and the target after it into one hit. Each mark lessens the weight of the insult
or threat it stands on. The four are composed into one machine of states and weighted arcs,
which reads every matched clause once. A document's score is a logistic function of its
clauses' weights; isolated words outside clauses don't exist.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out

#: Labelled documents to learn from, half of each class where there are as many; more are
#: thinned out by the hash of their id.
MAX_LABELLED = 8_000
STEM_LENGTHS = range(4, 8)
#: Least likelihood ratio statistic, and documents, of a learned stem.
LEAST_RATIO, LEAST_DOCS = 22.0, 5

# Seed words of the grammar, by role.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile bastard retard vermin dumb fool jerk filth".split()
THREATS = "kill hurt destroy beat stab shoot burn crush smash murder".split()
TARGETS = "you your yours u he she they them him her his their these those people tu te vous votre ihr du dich euch sie usted ustedes ellos".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine pas jamais nunca jamás".split()
REPORTS = "said says told wrote called claimed reported according quoted sagte schrieb dit écrit dijo escribió".split()
TARGET_GAIN, NEGATION_LOSS, REPORT_LOSS, THREAT, NEAR = 0.25, 0.5, 0.3, 2.0, 3

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_PIECE = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"\u201c\u201d\u00ab\u00bb]")
_CLAUSE = re.compile(r"[.!?;\n]+")


def stems_of(text: str | None) -> set[str]:
    """Distinct words, as `word$`, and their prefixes of the stem lengths."""
    out = set()
    for w in set(_WORD.findall((text or "").lower())):
        out.add(f"{w}$")
        for n in STEM_LENGTHS:
            if len(w) >= n:
                out.add(w[:n])
    return out


def likelihood_ratio(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """The G statistic of a stem's counts; negative where it marks the other class."""

    def ll(k, n, p):
        return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)

    p, q, r = pos / max(n_pos, 1), neg / max(n_neg, 1), (pos + neg) / max(n_pos + n_neg, 1)
    g = 2 * (ll(pos, n_pos, p) + ll(neg, n_neg, q) - ll(pos, n_pos, r) - ll(neg, n_neg, r))
    return g if p > q else -g


def choose(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """Weights (log odds) of the seeds and of the stems that stand out; of a stem and its
    prefix the stronger stays."""
    ranked = sorted(((likelihood_ratio(p, n, n_pos, n_neg), -len(s), s, p, n) for s, p, n in counts), reverse=True)
    out = {f"{w}$": 3.0 for w in INSULTS}
    taken: set[str] = set()
    for g, _, stem, p, n in ranked:
        if g < LEAST_RATIO or p < LEAST_DOCS:
            continue
        bare = stem.rstrip("$")
        if any(bare[:k] in taken for k in STEM_LENGTHS) and stem not in out:
            continue
        weight = math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1))
        if weight < 1.5:
            continue
        out[stem] = min(weight, 8.0)
        if not stem.endswith("$"):
            taken.add(stem)
    return out


# ---- transducers: symbols are a role and its marks ("insult-", "insult-n", "insult-nr" ...)

MARKS = ("-", "-n", "-r", "-nr")
MARKED = ("insult", "threat")
PLAIN = ("target", "negation", "report", "quote", "end", "hit")
SYMBOLS = [r + m for r in MARKED for m in MARKS] + list(PLAIN)


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine: ``arcs[state][symbol]`` is (next state, symbol, weight factor),
    and ``final`` the factor of a path's insults that ends in a state. State 0 begins."""

    arcs: tuple[dict[str, tuple[int, str, float]], ...]
    final: tuple[float, ...]


def machine(n: int, moves: dict[tuple[int, str], tuple[int, str, float]], final: dict[int, float] | None = None) -> Transducer:
    """A transducer that lets every symbol pass, with these exceptions."""
    arcs = tuple({x: moves.get((s, x), (s, x, 1.0)) for x in SYMBOLS} for s in range(n))
    return Transducer(arcs, tuple((final or {}).get(s, 1.0) for s in range(n)))


def marking(state: int, mark: str, keep: int, loss: float) -> dict:
    """In ``state`` insults and threats get a mark, at a loss."""
    moves = {}
    for r in MARKED:
        for m in MARKS:
            if mark not in m:
                new = "-" + "".join(x for x in "nr" if x in m + mark)
                moves[state, r + m] = (keep, r + new, 1 - loss)
    return moves


def negation() -> Transducer:
    """State k: a negation's scope goes on for k - 1 more words."""
    moves = {}
    for k in range(NEAR + 1):
        moves[k, "negation"] = (NEAR, "negation", 1.0)
        if k:
            moves[k, "end"] = (k - 1, "end", 1.0)
            moves |= marking(k, "n", k, NEGATION_LOSS)
    return machine(NEAR + 1, moves)


def reported() -> Transducer:
    """States: plain, after a verb of saying, in quotation marks, both."""
    moves = {}
    for s in range(4):
        moves[s, "report"] = (s | 1, "report", 1.0)
        moves[s, "quote"] = (s ^ 2, "quote", 1.0)
        if s:
            moves |= marking(s, "r", s, REPORT_LOSS)
    return machine(4, moves)


def targeted() -> Transducer:
    """State 1: the clause names a target, before its insults or after them."""
    return machine(2, {(0, "target"): (1, "target", 1.0)}, {1: 1 + TARGET_GAIN})


def threatened() -> Transducer:
    """State k > 0: a threat with the marks ``MARKS[k - 1]`` waits for a target; the two are a hit,
    whose weight the marks have lessened. Threats alone leave nothing."""
    moves = {}
    for s in range(len(MARKS) + 1):
        for k, m in enumerate(MARKS):
            moves[s, "threat" + m] = (k + 1, "end", 1.0)
        if s:
            loss = (1 - NEGATION_LOSS * ("n" in MARKS[s - 1])) * (1 - REPORT_LOSS * ("r" in MARKS[s - 1]))
            moves[s, "target"] = (0, "hit", THREAT * loss)
    return machine(len(MARKS) + 1, moves)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that reads what ``first`` reads and writes what ``second`` makes of its output."""
    number, arcs, at = {(0, 0): 0}, [], 0
    states = [(0, 0)]
    while at < len(states):
        a, b = states[at]
        out = {}
        for x in SYMBOLS:
            a2, y, v = first.arcs[a][x]
            b2, z, w = second.arcs[b][y]
            if (a2, b2) not in number:
                number[a2, b2] = len(states)
                states.append((a2, b2))
            out[x] = (number[a2, b2], z, v * w)
        arcs.append(out)
        at += 1
    return Transducer(tuple(arcs), tuple(first.final[a] * second.final[b] for a, b in states))


@cache
def clause_machine() -> Transducer:
    return compose(compose(compose(negation(), reported()), targeted()), threatened())


class Grammar:
    """The automaton that accepts insults in a text, and the composed machine that reads the
    clauses they stand in."""

    def __init__(self, weights: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for stem, weight in weights.items():
            bare, whole = stem.rstrip("$"), stem.endswith("$")
            held = self.automaton.get(bare, None)
            entry = (len(bare), max(weight, held[1]) if held else weight, whole and (held[2] if held else True))
            self.automaton.add_word(bare, entry)
        for w in THREATS:
            if w not in self.automaton:
                self.automaton.add_word(w, (len(w), 0.0, True))
        self.automaton.make_automaton()
        self.machine = clause_machine()
        self.roles: dict[str, list[str]] = {}
        for words, symbol in ((THREATS, "threat-"), (TARGETS, "target"), (NEGATIONS, "negation"), (REPORTS, "report")):
            for w in words:
                self.roles.setdefault(w, []).append(symbol)

    def hits(self, text: str) -> dict[int, tuple[int, float]]:
        """start -> (length, weight) of accepted words; a stem accepts the words it begins."""
        out: dict[int, tuple[int, float]] = {}
        n = len(text)
        for last, (size, weight, whole) in self.automaton.iter(text):
            start = last + 1 - size
            if start and text[start - 1].isalpha() or whole and last + 1 < n and text[last + 1].isalpha():
                continue
            if weight >= out.get(start, (0, -1.0))[1]:
                out[start] = (size, weight)
        return out

    def clauses(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, weight) of every clause with an accepted word."""
        text = (text or "").lower()
        hits = self.hits(text)
        if not hits:
            return []
        out, places, k = [], sorted(hits), 0
        ends = [m.start() for m in _CLAUSE.finditer(text)] + [len(text)]
        start = 0
        for end in ends:
            inside = []
            while k < len(places) and places[k] < end:
                inside.append(places[k])
                k += 1
            if inside:
                if (w := self.walk(text, start, end, {p: hits[p] for p in inside})) > 0:
                    out.append((start, end, w))
            start = end
            if k == len(places):
                break
        return out

    def walk(self, text: str, start: int, end: int, hits: dict[int, tuple[int, float]]) -> float:
        """What the composed machine makes of the clause: the weights of its insults and hits."""
        arcs, state, insults, threats = self.machine.arcs, 0, 0.0, 0.0
        for m in _PIECE.finditer(text, start, end):
            if not m[0][0].isalpha():
                state = arcs[state]["quote"][0]
                continue
            weight = hits.get(m.start(), (0, 0.0))[1]
            symbols = self.roles.get(m[0], [])
            for symbol in (["insult-", *symbols, "end"] if weight > 0 else [*symbols, "end"]):
                state, out, factor = arcs[state][symbol]
                if out == "hit":
                    threats += factor
                elif symbol == "insult-":
                    insults += weight * factor
        return insults * self.machine.final[state] + threats

    def numbers(self, text: str | None) -> list[float]:
        """What the logistic function reads: heaviest clause, all clauses, their number, and
        their share of the text."""
        found = self.clauses(text)
        if not found:
            return [0.0, 0.0, 0.0, 0.0]
        weights = [w for _, _, w in found]
        total = sum(weights)
        return [min(max(weights), 12.0), math.log1p(total), math.log1p(len(found)), math.log1p(1000 * total / (len(text) + 200))]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Coefficients (constant last) by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    shrink = ridge * np.eye(len(b)) * max(weight.sum(), 1) / 100
    shrink[-1, -1] = 1e-9
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + shrink + 1e-9 * np.eye(len(b)), z.T @ (weight * (y - p)) - shrink @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels of held-out documents, null labels and labels without document are not learned
    from; without labels the seeds alone score, and a doc_id with several labels counts as toxic
    if one of them says so. Null and empty texts have the score of texts without matched clauses;
    very long texts are read whole. Repeated rows are scored each; a null doc_id is not held out.
    Other columns, whatever their names, are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).alias("y"))
    per_class = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {c: sum(n for v, n in per_class.items() if (v == 1) == bool(c)) for c in (0, 1)}
    share = {c: min(1.0, MAX_LABELLED / 2 / n) if n else 0.0 for c, n in total.items()}
    million = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000))
    picked = known.where(million < F.when(F.col("y") == 1, int(share[1] * 1e6)).otherwise(int(share[0] * 1e6))).select(F.col("doc_id").alias("_id"), (F.col("y") == 1).cast("int").alias("y"))
    # at most about MAX_LABELLED rows of two numbers
    sample = scratch.write(docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "y"), "sample")
    seen = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def count(batches):
        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s in stems_of(text):
                    held.setdefault(s, [0, 0])[y] += 1
            if len(held) > 300_000:
                yield stem_batch(held)
                held = {}
        yield stem_batch(held)

    stems = sample.mapInArrow(count, "stem string, pos bigint, neg bigint").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    often = stems.where((F.col("pos") >= LEAST_DOCS) & (F.col("pos") * max(seen.get(0, 0), 1) > 4 * F.col("neg") * max(seen.get(1, 0), 1)))
    counts = [(r["stem"], r["pos"], r["neg"]) for r in often.collect()]  # bounded by the sample
    weights = choose(counts, seen.get(1, 0), seen.get(0, 0))
    grammar = spark.sparkContext.broadcast(weights)

    def read(batches):
        g = Grammar(grammar.value)
        for batch in batches:
            rows = [g.numbers(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    fitted = sample.mapInArrow(read, "x array<double>, y int").collect()  # bounded by MAX_LABELLED
    if len(seen) == 2:
        y = np.array([r["y"] for r in fitted])
        weight = np.where(y == 1, total[1] / max(seen[1], 1), total[0] / max(seen[0], 1))
        b = logistic(np.array([r["x"] for r in fitted]), y, weight / weight.mean())
    else:
        b = np.array([0.5, 0.5, 0.0, 0.0, -3.0])
    model = spark.sparkContext.broadcast(b)

    def score(batches):
        g, b = Grammar(grammar.value), model.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x = np.array([g.numbers(t) for t in part.column(1).to_pylist()]).reshape(part.num_rows, 4)
                p = 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stem_batch(held: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64())], ["stem", "pos", "neg"])
