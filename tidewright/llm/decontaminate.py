"""Benchmark decontamination: pigeonhole pieces and Myers' bit-parallel edit distance.

A test item of n characters has an error budget of k = n * rate. Cut into k + 1 pieces, at
least one piece must stand unchanged in any passage within the budget. An Aho-Corasick
automaton finds all pieces in one pass over a text; each hit names a place, and the item's
distance to the best passage there decides.

Texts are compared as lower-case letters and digits, other runs being one blank. Items and
texts stand between blanks, so the edge of an item's first and last word counts like any other
character, and items too short for a budget are found as whole words alone.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.08
#: Characters of benchmark text that a pass over the documents looks for; a larger benchmark
#: takes more passes, so what is sent to executors stays bounded.
BLOCK_CHARS = 4_000_000

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate)


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length, with their offsets."""
    at = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def best_end(item: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the passage of ``text`` nearest to ``item``, the leftmost of equals."""
    if not item:
        return 0, 0
    m = len(item)
    if masks is None:
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = mh << 1 & full | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Finder:
    """Finds the passages of a block of items in a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items, pieces = [], {}
        for item_id, text in items:
            body = normal(text)
            if not body:
                continue
            self.items.append((item_id, f" {body} ", budget(body, rate)))
            for at, piece in cut(*self.items[-1][1:]):
                pieces.setdefault(piece, []).append((len(self.items) - 1, at))
        self.masks = [None] * len(self.items)
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end), the nearest passage of each item; end: where it ends in the
        normal text."""
        body = f" {normal(text)} "
        tried: dict[tuple[int, int], None] = {}
        best: dict[int, tuple[int, int]] = {}
        for last, (size, places) in self.automaton.iter(body) if self.any else ():
            for i, at in places:
                item_id, item, k = self.items[i]
                start = last + 1 - size - at
                if best.get(i, (k + 1,))[0] == 0 or (i, start) in tried:
                    continue
                tried[i, start] = None
                if body.startswith(item, max(start, 0)) and start >= 0:
                    found = (0, start + len(item))
                elif k:
                    low = max(0, start - k)
                    if self.masks[i] is None:
                        self.masks[i] = {c: sum(1 << p for p, x in enumerate(item) if x == c) for c in set(item)}
                    d, end = best_end(item, body[low : start + len(item) + k], self.masks[i])
                    found = (d, low + end)
                else:
                    continue
                if found[0] <= k and found < best.get(i, (k + 1, 0)):
                    best[i] = found
        return sorted((self.items[i][0], d, len(body[1:end].rstrip())) for i, (d, end) in best.items())


def blocks(benchmark: DataFrame, block_chars: int):
    """The items in lists of at most ``block_chars`` characters (an item longer than that is a
    list of its own)."""
    held, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if held and size + len(r["text"]) > block_chars:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if held:
        yield held


_BUILT: dict[str, Finder] = {}


def finder_of(name: str, items: list[tuple[int, str]], rate: float) -> Finder:
    """The finder of the block of this name. A worker keeps that of its last block."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Finder(items, rate)
    return _BUILT[name]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end): the nearest passage of every item within its budget.

    distance: edits between the item and the passage, word edges included; end: where it ends
    in the normal form of the text. Null or empty texts hold nothing; very long texts are read
    whole; items that are null, without id or without letters and digits are not looked for;
    rows that repeat are reported once each, equal items of one id once; ties go to the leftmost
    of the nearest passages. Columns besides doc_id and text, whatever their names, are left
    out. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, distance bigint, end bigint"
    out = None
    for block in blocks(benchmark, block_chars):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, sent=sent, name=name):
            finder = finder_of(name, sent.value, rate)
            for batch in batches:
                rows = []
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        rows += [(doc, *hit) for hit in finder.find(text)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "end"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.select("doc_id").where("false").selectExpr("doc_id", *("cast(null as bigint) " + c for c in ("item_id", "distance", "`end`")))


def without_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs``, with all its columns, without the rows whose text holds a benchmark passage.

    Each row is judged by its own text: null and empty texts, and rows without id, stay unless
    it holds one; repeated rows share their fate. An empty benchmark leaves all rows.
    """
    spark = docs.sparkSession
    kept = docs
    for block in blocks(benchmark, block_chars):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, sent=sent, name=name):
            finder = finder_of(name, sent.value, rate)
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not finder.find(x) for x in text], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_ids): contaminated documents and the items they hold; rows that share a
    doc_id (null included) are one document, and clean documents have no row."""
    return matches(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
