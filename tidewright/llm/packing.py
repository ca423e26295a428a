"""Packing documents into fixed windows, filled with lexically near documents.

Tokens are made once, written, and term counts over all documents become BM25 weights (one
number per token id, so their size is that of the vocabulary). Documents are put in the order
of a content key (a Hilbert position over the main directions of a sample's weights), so that
near ones meet wherever they lay in the table. Each shard (a stretch of that order, of bounded
token count) builds a BM25 inverted index over its documents. A
seed document opens a window; the index returns its nearest unused documents, which fill the
window greedily, the last one being cut where the window ends and going on in the next one.
What is left of a shard at its end is cut into powers of two, so no token is padding.
"""

from __future__ import annotations

import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .neighbours import hilbert

WINDOW = 1024
END_ID = 0
#: Tokens of one shard; bounds a task's memory whatever the size of its partition.
SHARD_TOKENS = 4_000_000
#: Terms held by more than one document in so many of a shard are scored by dense products.
DENSE = 8
#: Numbers that the dense scores of one batch of seeds may take.
BATCH = 1 << 22
K1, B = 1.2, 0.75
#: Documents of the sample that gives the content key, its directions, and bits of each.
SAMPLE, DIRECTIONS, BITS = 768, 8, 4


def byte_of_char() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of the byte-level BPE in a ``tokenizers`` JSON file, whose merges are in id order,
    so that its ids are the ranks of its pieces."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        chars = byte_of_char()
        ranks = {bytes(chars[c] for c in w): i for w, i in vocab.items() if all(c in chars for c in w) and w != "<|endoftext|>"}
        if max(vocab.values()) >= 1 << 16:
            raise ValueError(f"{path}: ids beyond 16 bits")
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids (the vocabulary is smaller than 2**16)."""
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes() if text else b""


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the ids of the text, then the end id, as unsigned 16-bit numbers."""

    def run(batches):
        enc, end = encoder(tokenizer), np.array([END_ID], dtype="<u2").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([enc.ids(x or "") + end for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def ends_of_runs(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in order, and where the run of each different id ends."""
    s = d.astype(np.int32)  # 32-bit numbers sort several times faster than 16-bit ones
    s.sort()
    (inner,) = (s[1:] != s[:-1]).nonzero()
    last = np.empty(len(inner) + 1, np.int64)
    last[:-1], last[-1] = inner, len(s) - 1
    return s, last


def terms_of(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of a document, each once and in order, and how often each occurs."""
    s, last = ends_of_runs(d)
    n = last + 1
    n[1:] -= last[:-1] + 1
    return s[last], n


def weights_of(tf: np.ndarray, idf: np.ndarray, length, mean: float) -> np.ndarray:
    """BM25 weights of terms with these counts in documents of this length."""
    return (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))).astype(np.float32)


class ContentKey:
    """Documents as positions on a Hilbert curve, near ones mostly close to each other."""

    def __init__(self, sample: list[np.ndarray], idf: np.ndarray, mean: float):
        self.idf, self.mean = idf, mean
        held = [self.unit(d) for d in sample]
        columns, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        x = np.zeros((len(held), len(columns)), np.float32)
        x[np.repeat(np.arange(len(held)), [len(t) for t, _ in held]), at] = np.concatenate([w for _, w in held])
        x -= x.mean(axis=0)
        u, size, _ = np.linalg.svd(x @ x.T)
        k = min(DIRECTIONS, len(held))
        self.directions = np.zeros((1 << 16, DIRECTIONS), np.float32)
        self.directions[columns, :k] = x.T @ (u[:, :k] / np.sqrt(np.maximum(size[:k], 1e-9)))
        self.edges = np.quantile([w @ self.directions[t] for t, w in held], np.arange(1, 1 << BITS) / (1 << BITS), axis=0).T

    def unit(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, tf = terms_of(d)
        w = weights_of(tf, self.idf[t], len(d), self.mean)
        return t, w / max(float(np.sqrt(w @ w)), 1e-9)

    def of(self, docs: list[np.ndarray]) -> np.ndarray:
        at = np.array([w @ self.directions[t] for t, w in map(self.unit, docs)])
        return hilbert(np.stack([np.searchsorted(e, at[:, k]) for k, e in enumerate(self.edges)], axis=1), BITS)


def keyed(tokens: DataFrame, content) -> DataFrame:
    """(key, tie, doc_id, ids): ties are told apart by row, so that one content key may lie in
    many shards."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                key = content.value.of([np.frombuffer(x, "<u2") for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.arange(row, row + len(key)), pa.int64()), *part.columns], ["key", "tie", "doc_id", "ids"])
                row += len(key)

    return tokens.select("doc_id", "ids").mapInArrow(run, "key bigint, tie bigint, doc_id bigint, ids binary")


def term_counts(tokens: DataFrame) -> DataFrame:
    """(token, n): documents that hold the token, over all documents. A task sends one row per
    token at most."""

    def run(batches):
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                runs = [ends_of_runs(np.frombuffer(x, "<u2")) for x in batch.column(0).slice(k, 256).to_pylist()]
                n += np.bincount(np.concatenate([s[last] for s, last in runs]), minlength=len(n))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64())], ["token", "n"])

    return tokens.select("ids").mapInArrow(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


class Shard:
    """A BM25 inverted index over some documents, from which each is taken once."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        rows, terms, tf = [], [], []
        for i, d in enumerate(docs):
            t, n = terms_of(d)
            rows.append(np.full(len(t), i, np.int32))
            terms.append(t.astype(np.uint16))
            tf.append(n)
        row, term, tf = (np.concatenate(x) for x in (rows, terms, tf))
        length = np.array([len(d) for d in docs], np.float64)
        weight = weights_of(tf, idf[term], length[row], mean)
        self.own = np.split(np.arange(len(row)), np.cumsum([len(r) for r in rows])[:-1])
        self.term, self.weight = term, weight
        order = np.argsort(term, kind="stable")
        self.rows, self.weights = row[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        held = np.diff(self.at)
        common = np.flatnonzero(held > max(len(docs) // DENSE, 8))
        # a column of more than len(docs) / DENSE entries each: at most DENSE numbers an entry
        self.column = np.full(1 << 16, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(docs), len(common)), np.float32)
        for k, t in enumerate(common):
            a, z = self.at[t], self.at[t + 1]
            self.dense[self.rows[a:z], k] = self.weights[a:z]
        self.free = np.ones(len(docs), bool)
        self.ahead: dict[int, np.ndarray] = {}

    def prepare(self, seeds: np.ndarray) -> None:
        """Scores of the next seeds over the common terms, in one product."""
        asked = np.zeros((len(seeds), self.dense.shape[1]), np.float32)
        for k, s in enumerate(seeds):
            c = self.column[self.term[self.own[s]]]
            asked[k, c[c >= 0]] = 1
        self.ahead = dict(zip(seeds.tolist(), asked @ self.dense.T, strict=True))

    def near(self, seed: int):
        """Unused documents that share a term with the seed, best first, by BM25 over all its
        terms."""
        if seed not in self.ahead:
            self.prepare(np.array([seed]))
        score = self.ahead.pop(seed)
        rare = self.term[self.own[seed]]
        rare = rare[self.column[rare] < 0].astype(np.int64)
        first, n = self.at[rare], self.at[rare + 1] - self.at[rare]
        if total := int(n.sum()):
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(total)
            score = score + np.bincount(self.rows[at], self.weights[at], len(score))
        found = np.flatnonzero((score > 0) & self.free)
        score, k = score[found], 32
        if len(found) > k:  # few fill a window: the others are only sorted if they are asked for
            split = np.argpartition(-score, k)
            best, rest = split[:k], split[k:]
            yield from found[best[np.lexsort((best, -score[best]))]]
            found, score = found[rest], score[rest]
        yield from found[np.lexsort((found, -score))]


def order_of(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[int]:
    """The order in which a shard's documents fill its windows."""
    index, out, used = Shard(docs, idf, mean), [], 0
    seeds = np.argsort([-len(d) for d in docs], kind="stable")
    batch = max(1, min(32, BATCH // len(docs)))
    for k, seed in enumerate(seeds.tolist()):
        if not index.free[seed]:
            continue
        index.free[seed] = False
        out.append(seed)
        used += len(docs[seed])
        if not (room := -used % window):
            continue
        if seed not in index.ahead:
            later = seeds[k : k + 8 * batch]
            index.prepare(np.append(seed, later[index.free[later]][: batch - 1]))
        for i in index.near(seed):
            index.free[i] = False
            out.append(int(i))
            used += len(docs[i])
            if len(docs[i]) >= room:
                break
            room -= len(docs[i])
    return out


def windows(total: int, window: int) -> list[int]:
    """Sizes of a shard's sequences: full windows, then powers of two for the rest."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(ids: list, docs: list[np.ndarray], order: list[int], window: int, first_sequence: int):
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    sizes, seq, offset = windows(sum(map(len, docs)), window), 0, 0
    for i in order:
        d, start = docs[i], 0
        while start < len(d):
            n = min(len(d) - start, sizes[seq] - offset)
            yield ids[i], start, n, zlib.crc32(d[start : start + n].astype("<u4").tobytes()), len(d), first_sequence + seq, offset
            start, offset = start + n, offset + n
            if offset == sizes[seq]:
                seq, offset = seq + 1, 0


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """A row per piece; every token id of every document lies in exactly one piece.

    A null or empty text has the end id alone. Repeated rows and null ids are packed like any
    other row. sequence_id: the partition's number in the upper bits, a counter in the lower.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    tokens = scratch.write(tokenized(docs, tokenizer), "tokens")
    total, count = tokens.agg(F.sum(F.octet_length("ids") / 2), F.count(F.lit(1))).first()
    n = np.zeros(1 << 16)
    for r in term_counts(tokens).collect():  # at most 2**16 rows: the vocabulary
        n[r["token"]] = r["n"]
    weights = np.log1p((count - n + 0.5) / (n + 0.5)).astype(np.float32)
    idf = spark.sparkContext.broadcast(weights)
    mean = float(total or 1) / max(count, 1)

    def run(batches):
        sequence, ids, held, size = TaskContext.get().partitionId() << 33, [], [], 0

        def flush():
            nonlocal sequence
            rows = list(pieces(ids, held, order_of(held, idf.value, mean, window), window, sequence)) if held else []
            if rows:
                sequence = rows[-1][5] + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in PIECE.split(", ")])

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                held.append(np.frombuffer(raw, "<u2"))
                size += len(held[-1])
                if size >= SHARD_TOKENS:
                    yield from flush()
                    ids, held, size = [], [], 0
        yield from flush()

    if not count:
        return tokens.mapInArrow(run, PIECE)
    sample = tokens.select("ids").where(F.rand(7) < SAMPLE / count).limit(2 * SAMPLE).collect() or tokens.select("ids").limit(1).collect()
    content = spark.sparkContext.broadcast(ContentKey([np.frombuffer(r["ids"], "<u2") for r in sample], weights, mean))
    shards = -(-int(total) // SHARD_TOKENS)
    return keyed(tokens, content).repartitionByRange(shards, "key", "tie").sortWithinPartitions("key", "tie").select("doc_id", "ids").mapInArrow(run, PIECE)
