"""Operator 1, best-fit packing: pattern packing by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bucket_bits, numbered, stored
from tidemark.llm.tokens import coder


def pieces(docs: DataFrame, capacity: int, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece: a text's ids and end_id, cut only where longer than capacity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, ends in coder(tokenizer).encode_many(batch["text"], end_id):
                begin = np.concatenate(([0], ends[:-1]))
                n = -(-(ends - begin) // capacity)
                doc = np.repeat(np.arange(len(ends)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, (ends - begin)[doc] - start)
                first, data = 4 * (begin[doc] + start), memoryview(ids).cast("B")
                crc = [zlib.crc32(data[a : a + 4 * k]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
                own = batch["id"].take(pa.array(at + doc))
                yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(rows, f"id {slim.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All sets of two or three of the lengths present that fill the capacity; of two, the third is 0."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    a = present[present < capacity]
    two = a[(a * 2 >= capacity) & have[capacity - a]]
    out = [np.stack([two, capacity - two, 0 * two], 1)]
    for x in a:
        rest = capacity - x
        y = a[(a <= x) & (a * 2 >= rest) & (a < rest)]
        y = y[have[rest - y]]
        out.append(np.stack([np.full(len(y), x), y, rest - y], 1))
    return np.concatenate(out).astype(np.int64)


def least_squares(sets: np.ndarray, counts: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeats x >= 0 of the sets that minimise the squared error of the counts: multiplicative updates, which
    keep x non-negative because sets and counts are.  Length 0 stands for no document."""
    goal = counts.astype(float)
    goal[0] = 0
    back = lambda v: v[sets].sum(1)
    top = back(goal)
    x = np.full(len(sets), goal.sum() / max(1, 3 * len(sets)))
    for _ in range(rounds):
        made = np.bincount(sets.ravel(), np.repeat(x, 3), len(counts))
        made[0] = 0
        x *= top / np.maximum(back(made), 1e-12)
    return x


def _best_fit(counts: np.ndarray, capacity: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: sets of lengths and how many sequences hold them."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            best = next((s for s in range(length, capacity + 1) if room[s]), None) if room else None
            if best is None:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    room[capacity - each * length].append(((length,) * each, full))
                if rest:
                    room[capacity - rest * length].append(((length,) * rest, 1))
                break
            held, n = room[best].pop()
            take = min(n, left)
            if n > take:
                room[best].append((held, n - take))
            room[best - length].append(((*held, length), take))
            left -= take
    for groups in room.values():
        yield from groups


def plan(counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go: rows length, first (rank among the length's pieces), n, sequence, offset.

    Patterns that fill a sequence get rounded least-squares counts, the largest first, as far as their lengths
    last; best fit packs the rest.  Size depends on the capacity, not on the number of documents.
    """
    left = counts.astype(np.int64).copy()
    groups: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        groups.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    sets = patterns(np.flatnonzero(left), capacity)
    if len(sets):
        x = least_squares(sets, left)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1e-3:
                break
            held = tuple(int(v) for v in sets[k] if v)
            need = {v: held.count(v) for v in held}
            n = min(int(np.ceil(x[k])), *(int(left[v]) // c for v, c in need.items()))
            if n > 0:
                groups.append((held, n))
                for v, c in need.items():
                    left[v] -= n * c
    groups.extend(_best_fit(left, capacity))
    rows, used, sequence = [], np.zeros(len(counts), np.int64), 0
    for held, n in groups:
        offset = 0
        for v in held:
            rows.append((v, used[v], n, sequence, offset))
            used[v] += n
            offset += v
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "n", "sequence", "offset"]).sort_values(["length", "first"])


def pack(docs: DataFrame, capacity: int, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pack all documents: one row per piece with id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenized once; the slim table of pieces goes to the shared folder.  Only the histogram (capacity
    + 1 counts) reaches the driver.  Pieces are ranked within their length, in hash cells so that a length that many
    share is no big task, and look their place up in the plan.  Null and empty texts are one piece of end_id; a text of more than
    capacity tokens is pieces of capacity and a last one, however long it is; repeated rows are packed each, and pieces that tie in all that orders
    them stand in any order; null ids are ids; an empty table gives an empty result; other columns, whatever their names, are not read.
    """
    slim = stored(pieces(docs, capacity, tokenizer, id_col, text_col, end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in slim.groupBy("length").count().collect():
        counts[length] = n
    todo = plan(counts, capacity)
    bits = [(int(v), bucket_bits(int(counts[v]))) for v in np.flatnonzero(counts)]
    spread = slim.sparkSession.createDataFrame(bits, "length long, bits int")
    celled = (
        slim.join(F.broadcast(spread), "length")
        .withColumn("h", F.xxhash64("id", "piece", "ids_crc32"))
        .withColumn("cell", F.expr("if(bits = 0, 0L, shiftright(h, 64 - bits))"))
        .drop("bits")
    )
    ranked = numbered(celled, ["length"], "cell", ["h", "id", "piece", "start", "ids_crc32"], "rank")
    wide = int(counts.max(initial=0)) + 1
    keys = todo["length"].to_numpy() * wide + todo["first"].to_numpy()
    first, sequence, offset = (todo[c].to_numpy() for c in ("first", "sequence", "offset"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch.pop("rank").to_numpy()
            at = np.searchsorted(keys, batch["length"].to_numpy() * wide + rank, "right") - 1
            yield batch.assign(sequence_id=sequence[at] + rank - first[at], offset=offset[at])

    names = ["id", "piece", "start", "length", "ids_crc32"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    return ranked.select(*names, "rank").mapInPandas(rows, f"{kinds}, sequence_id long, offset long").withColumnRenamed("id", id_col)
