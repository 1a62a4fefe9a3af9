"""Operator 5, SimHash near-dedup over a byte-position inverted index with count filtering."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import stored, with_row_key

SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lists up to SMALL give all their links, larger ones a spanning forest of them; over BLOCK they are split.
SMALL, BLOCK = 32, 20_000
#: One of so many nodes is counted to find the large lists.
SAMPLED = 64


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def majority(hashes: np.ndarray) -> np.ndarray:
    """Per column of hashes (rows, words of 64 bits): the bits that are set in over half the rows."""
    n, width = hashes.shape
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    whole = n // 255 * 255
    count = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        count += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * count > n, bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of a text's word shingles, repeats included, by XXH64; zero without words."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest, k = xxhash.xxh64_intdigest, min(shingle, len(words))
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)]
    return int(majority(np.array(hashes, np.uint64)[:, None])[0])


def _mixed(x: np.ndarray, turns: range) -> np.ndarray:
    """Independent 64-bit hashes of x, a column for each turn (a multiply-xorshift finaliser)."""
    x = x[:, None] + np.array([((k + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1) for k in turns], np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; none without words, one of all words where they are fewer."""
    words = words_of(text)
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w, SEED) for w in words], np.uint64)
    chain = own[: max(1, len(own) - shingle + 1)].copy()
    for j in range(1, min(shingle, len(own))):
        chain = chain * np.uint64(0x100000001B3) + own[j : j + len(chain)]
    return np.unique(chain)


def overlap_least(size: int, similarity: float) -> int:
    """Shingles that a set of this size shares at least with any set at this Jaccard similarity or above."""
    return math.ceil(similarity * size - 1e-9)


def heads(own: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in one order for all texts, so many that no similar set can lie wholly behind them.

    Uncommon shingles come first, by hash; then those in common (ascending), by rank.
    """
    most = len(own) - overlap_least(len(own), similarity) + 1 if len(own) else 0
    if not len(common):
        return own[:most]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    often = common[at] == own
    out = own[~often][:most]
    if len(out) < most:
        out = np.concatenate([out, own[often][np.argsort(rank[at[often]])][: most - len(out)]])
    return out


def set_words(own: np.ndarray, checks: int) -> np.ndarray:
    """checks words of SimHash over the distinct shingles, then two words that name the set."""
    if not len(own):
        return np.zeros(checks + 2, np.uint64)
    size = 8192  # rows at a time, so that a very long text needs little memory
    parts = [majority(_mixed(own, range(checks))) if len(own) <= size else _majority_of_many(own, range(checks), size)]
    name = np.zeros(2, np.uint64)
    for at in range(0, len(own), size):
        name += _mixed(own[at : at + size], range(checks, checks + 2)).sum(0, dtype=np.uint64)
    return np.concatenate([*parts, name])


def _majority_of_many(x: np.ndarray, turns: range, size: int) -> np.ndarray:
    count = np.zeros(64 * len(turns), np.int64)
    for at in range(0, len(x), size):
        part = _mixed(x[at : at + size], turns)
        count += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(x), bitorder="little").view("<u8")


def slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Smaller batches, so that what is made of each takes little of the memory that workers of an executor share."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows].reset_index(drop=True)


def signatures(docs: DataFrame, id_col: str, text_col: str, make: Callable[[str | None], np.ndarray], width: int) -> DataFrame:
    """id and words w0.. of the signature of every row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sig = np.array([make(t) for t in batch.pop("text")], np.uint64).reshape(len(batch), width).view(np.int64)
            yield batch.assign(**{f"w{k}": sig[:, k] for k in range(width)})

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = f"id {slim.schema['id'].dataType.simpleString()}, " + ", ".join(f"w{k} long" for k in range(width))
    return slim.mapInPandas(rows, kinds)


def spanning(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the rows of words that differ in at most `most` bits, by breadth-first search."""
    left, queue, a, b = np.arange(1, len(words)), [0], [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            continue
        at = queue.pop()
        near = np.bitwise_count(words[left] ^ words[at]).sum(1, dtype=np.int64) <= most
        found = left[near]
        a.append(np.full(len(found), at)), b.append(found)
        queue.extend(found.tolist())
        left = left[~near]
    return np.concatenate(a or [left]).astype(np.int64), np.concatenate(b or [left]).astype(np.int64)


def bucket_links(start: np.ndarray, words: np.ndarray, most: int, first: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links inside consecutive buckets that begin at start.  first(a, b): whether this bucket is the pair's first."""
    size = np.diff(np.append(start, len(words)))
    own = np.repeat(np.where(size <= SMALL, np.arange(len(start)), -1), size)
    a, b = [], []
    for step in range(1, min(SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero((own[:-step] == own[step:]) & (own[step:] >= 0))
        i = i[np.bitwise_count(words[i] ^ words[i + step]).sum(1, dtype=np.int64) <= most]
        i = i[first(i, i + step)]
        a.append(i), b.append(i + step)
    for k in np.flatnonzero(size > SMALL):
        x, y = spanning(words[start[k] : start[k] + size[k]], most)
        a.append(x + start[k]), b.append(y + start[k])
    return np.concatenate(a or [start[:0]]), np.concatenate(b or [start[:0]])


def near_links(nodes: DataFrame, tables: int, checks: list[int], most: int, bytes_shared: int) -> DataFrame:
    """Links a, b between nodes whose check words differ in at most `most` bits, among all pairs that share at
    least bytes_shared positional bytes in one of the table words.

    A pair with that many bytes in common meets in a posting list keyed by some bytes_shared positions and
    the bytes there.  Lists of one are dropped before Python sees them.  In a list the shared bytes of a pair are
    tallied and its check words verified; a pair that meets in several lists counts in its first.  Large lists give
    a spanning forest of their links, which joins the same nodes; the largest are split before any task holds them.
    """
    subsets = list(combinations(range(8), bytes_shared))
    masks = np.array([sum(0xFF << 8 * p for p in s) for s in subsets], np.uint64).view(np.int64)
    names = [f"w{k}" for k in sorted({*range(tables), *checks})]
    lists = F.array(*[F.struct(F.lit(t * len(masks) + i).cast("int").alias("slot"), F.col(f"w{t}").bitwiseAND(F.lit(int(m))).alias("value")) for t in range(tables) for i, m in enumerate(masks)])
    carried = names if len(names) == 1 else []
    postings = lambda rows: rows.select("node", *carried, F.explode(lists).alias("list")).select("node", *carried, "list.slot", "list.value")
    shared = met(postings, nodes)
    if not carried:
        shared = stored(shared, "postings").join(nodes.select("node", *names), "node")
    rank = np.zeros(256, np.int64)
    for i, subset in enumerate(subsets):
        rank[sum(1 << p for p in subset)] = i

    def links(part: pd.DataFrame, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = part[[f"w{t}" for t in range(tables)]].to_numpy()
        words = part[[f"w{k}" for k in checks]].to_numpy().view(np.uint64)
        slot = part["slot"].to_numpy()

        def first(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            equal = np.ascontiguousarray(table[i] ^ table[j]).view(np.uint8).reshape(len(i), tables, 8) == 0
            tally = equal.sum(2)
            at = (tally >= bytes_shared).argmax(1)
            mine = equal[np.arange(len(i)), at]
            mine &= mine.cumsum(1) <= bytes_shared
            return slot[i] == at * len(masks) + rank[np.packbits(mine, axis=1, bitorder="little")[:, 0]]

        return bucket_links(start, words, most, first)

    return list_links(shared, names, bool(carried), links)


def set_links(nodes: DataFrame, checks: int, most: int) -> DataFrame:
    """Links a, b between nodes that share one of their heads and differ in at most `most` bits of their check words.

    Sets at the similarity that the heads were made for always share a head, so no such pair is lost here.
    """
    names = [f"w{k}" for k in range(checks)]
    shared = stored(met(lambda rows: rows.select("node", F.lit(0).alias("slot"), F.explode("heads").alias("value")), nodes), "postings")
    shared = shared.join(nodes.select("node", *names), "node")

    def links(part: pd.DataFrame, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return bucket_links(start, part[names].to_numpy().view(np.uint64), most, lambda i, j: np.ones(len(i), bool))

    return list_links(shared, names, False, links).distinct()


def met(postings: Callable[[DataFrame], DataFrame], nodes: DataFrame) -> DataFrame:
    """The postings (node, slot, value, ..) of lists of two or more, with x and y, 0 but for the members of large lists.

    A large list is dealt to blocks of about BLOCK nodes by hash, and each pair of blocks x, y is a list of its own, so that no
    task ever holds more and any two members still meet.  Which lists are large is seen in a hash sample of the nodes, of which a
    list of BLOCK has some 300; one just under or over it may fall on either side, which changes the work but no link.
    """
    own = F.xxhash64("node")
    count = postings(nodes.where(F.pmod(own, F.lit(SAMPLED)) == 0)).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    large = stored(count.select("slot", "value", F.ceil(F.col("n") * SAMPLED / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "large-lists")
    rows = postings(nodes)
    if large.isEmpty():
        rows = rows.withColumns({"x": F.lit(0), "y": F.lit(0)})
    else:
        rows = rows.join(large, ["slot", "value"], "left")
        block, other = F.coalesce(F.pmod(own, F.col("blocks")), F.lit(0)).cast("int"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
        rows = rows.withColumn("block", block).withColumn("other", other)
        rows = rows.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("blocks", "block", "other")
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("slot", "value", "x", "y"))).where("n > 1").drop("n")


def list_links(shared: DataFrame, names: list[str], dealt: bool, links: Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Links a, b inside the posting lists of shared (node, slot, value, x, y, names).  links gets whole lists and where they begin, and
    gives places of linked rows.  dealt: whether the rows of a list are together already."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def found(part: pd.DataFrame) -> pd.DataFrame:
            key, node = part[["slot", "value", "x", "y"]].to_numpy(), part["node"].to_numpy()
            a, b = links(part, np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1)))))
            return pd.DataFrame({"a": node[a], "b": node[b]}).drop_duplicates()

        for batch in batches:
            part = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = part[["slot", "value", "x", "y"]].to_numpy()
            tail = len(key)  # the last list may go on in the next batch
            while tail and (key[tail - 1] == key[-1]).all():
                tail -= 1
            held = part.iloc[tail:]
            if tail:
                yield found(part.iloc[:tail].reset_index(drop=True))
        if held is not None and len(held):
            yield found(held.reset_index(drop=True))

    keys = ["slot", "value", "x", "y"]
    part = shared if dealt else shared.repartition(*keys)
    return part.sortWithinPartitions(*keys).select("node", *names, *keys).mapInPandas(rows, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (smallest id in reach).

    Fingerprints of 64 bits link when at most max_bits (0 to 6) differ; such a pair shares at least
    8 - max_bits positional bytes.  Rows of one fingerprint are one node, so copies never make pairs.  Null, empty
    and wordless texts have fingerprint zero, linked like any other; texts of under `shingle` words have
    one shingle; null ids never name a component unless all its ids are null; repeated rows appear each; an empty table
    gives an empty result.  Texts are read whole, however long; other columns are not read, whatever their names.
    """
    sigs = stored(signatures(docs, id_col, text_col, lambda t: np.array([fingerprint(t, shingle)], np.uint64), 1), "fingerprints")
    nodes = stored(sigs.groupBy("w0").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(near_links(nodes, 1, [0], max_bits, 8 - max_bits))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("w0", "component_id")
    digits = F.lpad(F.lower(F.hex("w0")), 16, "0")
    return sigs.join(groups, "w0").select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


CHECKS = 8
#: Texts that are sampled for common shingles, and how many of these are kept.
SAMPLE, COMMON, OFTEN = 20_000, 50_000, 8
#: Standard errors of room for proposed links (sets of five shingles lose ties, which takes two or three of them), and the
#: heads (a fifth of the shingles) of the texts in a block that one task compares.
ERRORS, TOGETHER = 6.5, 100_000
#: Equal bytes of the first SimHash word that the index asks for, certain for pairs with up to 8 - BYTES different bits there.
BYTES = 4


def bits_at(similarity: float, bits: int, errors: float) -> int:
    """Bits of SimHash that may differ at a Jaccard similarity: those that the angle between the texts' shingle vectors
    explains, acos(2 s / (1 + s)) / pi of all, and so many standard errors of that estimate."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + errors * math.sqrt(bits * share * (1 - share)))


def common_shingles(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many texts of a hash sample have, ascending, and their ranks, most frequent last.

    They only order the heads, so that lists of common passages stay short; no result depends on them.
    """
    modulus = max(1, docs.count() // SAMPLE)
    texts = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(modulus)) == 0)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            sets = [shingle_set(t, shingle) for t in batch["text"]]
            yield pd.DataFrame({"s": np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)})

    counts = texts.mapInPandas(rows, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    found = counts.orderBy(F.desc("n"), "s").limit(COMMON).select("s").collect()
    common = np.array([r.s for r in found], np.int64).view(np.uint64)
    order = np.argsort(common)
    return common[order], (len(common) - order).astype(np.int32)


def set_signatures(docs: DataFrame, id_col: str, text_col: str, key: list[str], shingle: int, similarity: float, checks: int) -> DataFrame:
    """id, key, check words, k0 and k1 that name the shingle set, and its heads."""
    common, rank = common_shingles(docs, text_col, shingle)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            sets = [shingle_set(t, shingle) for t in batch.pop("text")]
            sig = np.array([set_words(s, checks) for s in sets], np.uint64).reshape(len(batch), checks + 2).view(np.int64)
            words = {name: sig[:, k] for k, name in enumerate([*(f"w{k}" for k in range(checks)), "k0", "k1"])}
            yield batch.assign(**words, heads=[heads(s, similarity, common, rank).view(np.int64) for s in sets])

    slim = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"key{j}") for j, c in enumerate(key)], F.col(text_col).alias("text"))
    kinds = ", ".join(f"w{k} long" for k in range(checks)) + ", k0 long, k1 long, heads array<long>"
    return slim.mapInPandas(rows, f"id {slim.schema['id'].dataType.simpleString()}, key0 long, key1 long, {kinds}")


def linked_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the sets whose Jaccard similarity is at least the limit, by breadth-first search."""
    size = np.array([len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    code = code.astype(np.int32)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)[np.argsort(code, kind="stable")]
    ends = np.append(0, np.cumsum(np.bincount(code, minlength=len(values))))
    begin = np.append(0, np.cumsum(size))
    left, queue, a, b = np.arange(1, len(sets)), [0], [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            continue
        at = queue.pop()
        lists = [owner[ends[c] : ends[c + 1]] for c in code[begin[at] : begin[at + 1]]]
        both = np.bincount(np.concatenate([*lists, owner[:0]]), minlength=len(sets))[left]
        near = both >= similarity * (size[left] + size[at] - both) - 1e-9
        found = left[near]
        a.append(np.full(len(found), at)), b.append(found)
        queue.extend(found.tolist())
        left = left[~near]
    return np.concatenate(a or [left]).astype(np.int64), np.concatenate(b or [left]).astype(np.int64)


def exact_links(texts: DataFrame, nodes: DataFrame, proposed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links a, b that join the nodes of each proposed group as all its pairs at the similarity would.

    Groups of over TOGETHER heads are compared block by block, each pair of blocks in a task of its own.
    """
    roots = proposed.select(F.col("root").alias("node"), "root").distinct().union(proposed.select("node", "root"))
    members = nodes.select("node", "key0", "key1", F.size("heads").alias("heads")).join(roots, "node")
    sizes = members.groupBy("root").agg(F.ceil(F.sum("heads") / TOGETHER).cast("int").alias("blocks"))
    members = members.join(sizes, "root")
    texts = texts.join(members, ["key0", "key1"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            yield batch.assign(own=[shingle_set(t, shingle).tobytes() for t in batch.pop("text")])

    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    made = texts.select("node", "root", "blocks", "text").mapInPandas(sets, "node long, root long, blocks int, own binary").withColumn("block", own)
    made = made.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    made = made.withColumns({"x": F.least("block", F.col("other").cast("long")), "y": F.greatest("block", F.col("other").cast("long"))})

    def links(part: pd.DataFrame) -> pd.DataFrame:
        node = part["node"].to_numpy()
        a, b = linked_sets([np.frombuffer(s, np.uint64) for s in part["own"]], similarity)
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return made.select("node", "root", "x", "y", "own").groupBy("root", "x", "y").applyInPandas(links, "a long, b long")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, checks: int = CHECKS, plain_table: bool = False) -> DataFrame:
    """The rows of docs but for near copies: of each component the row with the smallest id stays, with all its columns.

    SimHash of 8 * checks bytes over the `shingle`-word shingles, with ERRORS standard errors of room, proposes links between pairs that the
    byte-position inverted index of its first word counts BYTES or more equal bytes for.  No such count is certain at the similarity, so the
    same is asked of pairs that share one of their heads, as all sets at the similarity or above do.  Groups of proposed links are then
    compared shingle by shingle, and only pairs at the similarity link.

    Null, empty and wordless texts are all one group; shorter texts than a shingle have one of all their words; very long ones are read
    whole.  Null ids stay only in groups without any other id; of repeated rows one stays; an empty table gives an empty result; no column's name can
    clash.  plain_table: docs is read from files as it is, which saves a copy of it.
    """
    keyed, key = with_row_key(docs, plain_table)
    sigs = stored(set_signatures(keyed, id_col, text_col, key, shingle, similarity, checks), "signatures")
    best = F.min_by(F.struct("id", "key0", "key1"), F.struct(F.col("id").isNull(), "id", "key0", "key1")).alias("best")
    alike = [F.first(c).alias(c) for c in (*(f"w{k}" for k in range(checks)), "heads")]
    nodes = sigs.groupBy("k0", "k1").agg(best, *alike).select("best.*", *[f"w{k}" for k in range(checks)], "heads")
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    most = bits_at(similarity, 64 * checks, ERRORS)
    indexed = near_links(nodes, 1, list(range(checks)), most, BYTES)
    proposed = components(indexed.union(set_links(nodes, checks, most)).distinct())
    texts = keyed.select(*[F.col(c).alias(f"key{j}") for j, c in enumerate(key)], F.col(text_col).alias("text"))
    roots = components(exact_links(texts, nodes, proposed, shingle, similarity))
    kept = nodes.select("id", "key0", "key1", "node").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(best)
    kept = kept.select(*[F.col(f"best.key{j}").alias(c) for j, c in enumerate(key)])
    return keyed.join(kept, key, "left_semi").select(*[f"`{c}`" for c in docs.columns])
