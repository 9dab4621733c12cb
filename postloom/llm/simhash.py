"""SimHash fingerprints of word shingles and search for those within a Hamming radius.

Rows that agree in a table's bits form a group. Within a group comparison is bit-sliced: 64 members form a block of
bit planes; a query flips the planes where its bit is set, and carry-save counters add the planes for 64 distances
at a time. A (query, block) pair is abandoned once all its distances exceed the radius.

`band_pairs` is exact, as fingerprints within radius r agree in at least two of r + 2 bands. No bands can serve the
radius of near copies, so `deduplicated` brings those together by their rarest shingles: sets of similarity 0.8 or
more share one of the first fifth of their shingles in any common order. The bit-sliced comparison of wider
fingerprints is the sieve inside these groups, and the candidates' sets of shingles decide.

Equal fingerprints are collapsed before the search. A group of more than `BLOCK_ROWS` fingerprints is cut into parts
and every two parts meet in a group of their own, so no task holds more than two parts of one group.

Defined results: words are maximal runs without ASCII white space; A-Z are lower-cased only; a null or empty text
has fingerprint zero and links like any other; a null doc_id stays null and takes part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.common import NULL_ID, mixed, settled
from postloom.llm.components import connected

SEED, SHINGLE, RADIUS = 42, 3, 3
BLOCK_ROWS = 4096
#: (query, block) pairs compared at once, and shingles hashed at once.
PAIRS_AT_ONCE, SHINGLES_AT_ONCE = 1 << 14, 1 << 16
ONES = np.uint64(2**64 - 1)
GROUP = ["bands", "key", "part"]


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle in its place; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    shingles = zip(*(words[i:] for i in range(shingle)), strict=False)
    hashes = (xxhash.xxh64_intdigest(b" ".join(s), seed) for s in shingles)
    return np.fromiter(hashes, dtype=np.uint64, count=len(words) - shingle + 1)


def set_name(hashes: np.ndarray) -> int:
    """Names a sorted set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes())


def voted(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """`width` words of 64 bits; the first holds the votes of the hashes, the others those of mixed copies."""
    votes = np.zeros(64 * width, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        some = hashes[at : at + SHINGLES_AT_ONCE]
        copies = [some, *(mixed(some + np.uint64(k)) for k in range(1, width))]
        bits = np.unpackbits(np.column_stack(copies).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED, width: int = 1) -> np.ndarray:
    """The votes of all shingles of the text, repeats included."""
    return voted(shingle_hashes(text, shingle, seed), width)


def fingerprints(
    df: DataFrame, shingle: int = SHINGLE, seed: int = SEED, width: int = 1, distinct: bool = False
) -> DataFrame:
    """doc_id, text_key (hash of the text), node (bigint that names the fingerprint) and its bytes as `print`.

    With `distinct` a shingle votes once however often it occurs, and `node` names the set of shingles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [shingle_hashes(t, shingle, seed) for t in batch["text"]]
            if distinct:
                hashes = list(map(np.unique, hashes))
            found = [voted(h, width) for h in hashes]
            if distinct:
                nodes = [set_name(h) for h in hashes]
            else:
                nodes = [p[0] if width == 1 else xxhash.xxh64_intdigest(p.tobytes()) for p in found]
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(batch["doc_id"], dtype="Int64"),
                    "text_key": batch["text_key"],
                    "node": np.array(nodes, dtype=np.uint64).view(np.int64),
                    "print": [p.tobytes() for p in found],
                }
            )

    rows = df.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInPandas(run, "doc_id bigint, text_key bigint, node bigint, print binary")


def band_pairs(radius: int, bits: int = 64) -> list[np.ndarray]:
    """Bits of every two of radius + 2 bands."""
    bands = np.array_split(np.arange(bits), radius + 2)
    return [np.concatenate(two) for two in combinations(bands, 2)]


def near_masks(queries: np.ndarray, planes: np.ndarray, counts: np.ndarray, radius: int) -> np.ndarray:
    """For each pair of a query and a block of up to 64 members, the lanes within the radius.

    `queries` (pairs x words) are fingerprints; `planes` (pairs x bits) hold bit k of member j as bit j of plane k;
    `counts` are the members. The counters are as deep as the radius needs; a lane over the radius stays over.
    """
    depth = (radius + 1).bit_length()
    start = np.uint64(2**depth - 1 - radius)  # counters begin here, so that a carry out of the last means over
    lanes = np.where(counts >= 64, ONES, (np.uint64(1) << (counts & 63).astype(np.uint64)) - np.uint64(1))
    result = np.zeros(len(queries), dtype=np.uint64)
    alive, over = np.arange(len(queries)), ~lanes
    counters = [np.full(len(queries), ONES if int(start) >> k & 1 else 0, dtype=np.uint64) for k in range(depth)]
    for plane in range(planes.shape[1]):
        bit = (queries[alive, plane // 64] >> np.uint64(plane % 64)) & np.uint64(1)
        carry = planes[alive, plane] ^ (bit * ONES)
        for k, counter in enumerate(counters):
            carry, counters[k] = counter & carry, counter ^ carry
        over = over | carry
        if plane % 8 == 7:
            keep = over != ONES
            if not keep.all():
                alive, over, counters = alive[keep], over[keep], [c[keep] for c in counters]
            if not len(alive):
                break
    result[alive] = ~over
    return result


def _planes(prints: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bit planes of the blocks prints[first : first + count]."""
    lanes = np.minimum(first[:, None] + np.arange(64), len(prints) - 1)
    members = np.where((np.arange(64) < counts[:, None])[:, :, None], prints[lanes], np.uint64(0))
    as_bytes = members.astype("<u8").view(np.uint8)
    bits = np.unpackbits(as_bytes, axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def links(prints: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) that connect what the radius links within each group; equal groups stand together.

    The edges have the same connected components as all links; each joins a row to the first of its component.
    """
    n = len(prints)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, n])
    label = np.arange(n)
    per_group = -(-sizes // 64)
    block_group = np.repeat(np.arange(len(starts)), per_group)
    inside = np.arange(len(block_group)) - np.repeat(np.cumsum(per_group) - per_group, per_group)
    first = starts[block_group] + 64 * inside
    counts = np.minimum(64, starts[block_group] + sizes[block_group] - first)
    # Pairs of each row of a group with each block of the group, in slices.
    pairs = sizes[block_group]
    ends = np.cumsum(pairs)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, int(ends[-1]) if n else 0, PAIRS_AT_ONCE):
        flat = np.arange(at, min(at + PAIRS_AT_ONCE, int(ends[-1])))
        block = np.searchsorted(ends, flat, side="right")
        query = starts[block_group[block]] + flat - (ends[block] - pairs[block])
        used, back = np.unique(block, return_inverse=True)
        planes = _planes(prints, first[used], counts[used])[back]
        mask = near_masks(prints[query], planes, counts[block], radius)
        own = (query >= first[block]) & (query < first[block] + 64)
        mask = np.where(own, mask & ~(np.uint64(1) << ((query - first[block]) & 63).astype(np.uint64)), mask)
        keep = mask != 0
        found.append((query[keep], first[block[keep]], mask[keep]))
    changed = any(len(q) for q, _, _ in found)
    while changed:
        before = label.copy()
        for query, base, mask in found:
            on = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            near = np.where(on, label[np.minimum(base[:, None] + np.arange(64), n - 1)], n).min(axis=1)
            np.minimum.at(label, query, near)
        label = label[label]
        changed = not np.array_equal(label, before)
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _keyed(values: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """Every row of node and print once per table, with the bits that the table reads as `key`."""
    weights = [1 << np.arange(len(t), dtype=np.int64) for t in tables]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            raw = np.frombuffer(b"".join(batch["print"]), dtype=np.uint8).reshape(len(batch), -1)
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            for k, (table, weight) in enumerate(zip(tables, weights, strict=True)):
                key = bits[:, table].astype(np.int64) @ weight
                yield pd.DataFrame({"bands": k, "key": key, "node": batch["node"], "print": batch["print"]})

    return values.select("node", "print").mapInPandas(run, "bands int, key bigint, node bigint, print binary")


def _groups(keyed: DataFrame, block_rows: int) -> DataFrame:
    """The rows of groups of two or more, with `part`: a group of more than `block_rows` rows is cut, and every two
    cuts meet in one part."""
    sizes = keyed.groupBy("bands", "key").agg(F.count(F.lit(1)).alias("rows"))
    sized = keyed.join(sizes.where("rows > 1"), ["bands", "key"])
    cuts = F.ceil(F.col("rows") / block_rows).cast("int")
    return _cut(sized.withColumn("cuts", cuts)).select(*GROUP, "node", "print")


def _cut(sized: DataFrame) -> DataFrame:
    """Rows with `node` and the `cuts` of their group, copied to every part that their own cut meets another in.

    One row takes as many copies as its group has cuts; a group within the bound has one cut and one part.
    """
    return (
        sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn("part", F.least("own", "other") * F.col("cuts") + F.greatest("own", "other"))
    )


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def linking_edges(values: DataFrame, tables: list[np.ndarray], radius: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between nodes, with the connected components of all links that the tables bring together.

    `values` has one row for each node, with its `print`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (_edges(rows, radius) for rows in _whole_groups(batches, GROUP))

    rows = _groups(_keyed(values, tables), block_rows)
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "node").mapInPandas(run, EDGE)


def _whole_groups(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows, sorted by `columns`, cut so that no group of equal values is divided."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(held):
            continue
        same = (held[columns] == held[columns].iloc[-1]).all(axis=1).to_numpy()
        last = int(np.argmax(same))  # rows are sorted: the open group is at the end
        if last:
            yield held.iloc[:last]
            held = held.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _edges(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    group = rows[GROUP].ne(rows[GROUP].shift()).any(axis=1).cumsum().to_numpy()
    prints = np.frombuffer(b"".join(rows["print"]), dtype="<u8").reshape(len(rows), -1)
    a, b = links(prints, group, radius)
    node = rows["node"].to_numpy()
    return pd.DataFrame({"a": node[a], "b": node[b]})


def near_duplicates(
    prints: DataFrame, tables: list[np.ndarray], radius: int = RADIUS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The rows of `fingerprints` with `component` (names the group) and component_id (its smallest doc_id)."""
    prints = settled(prints)
    classes = prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("print").alias("print"))
    parts = connected(linking_edges(classes.select("node", "print"), tables, radius, block_rows))
    placed = classes.select("node", "first").join(parts, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "component").select("node", "component", "component_id")
    return prints.join(named, "node")


# Fixed values of `deduplicated`: 256 bits; documents with Jaccard similarity 0.8 of their shingles differ in 15 % of
# the bits (39, standard deviation 6; more in texts of few shingles), unrelated ones in half (128, 8).
WIDE, WIDE_SHINGLE, WIDE_RADIUS = 4, 5, 84
#: Cells that count the sets a shingle stands in, registers a cell, and cells that are merged as one row.
CELLS, REGISTERS, SLICE = 1 << 20, 4, 1 << 16
#: Tasks whose registers are merged in one step, and rows of a group that is compared by itself.
MERGED_AT_ONCE, LARGE = 1024, 256
#: Numerator and denominator of the least similarity of near copies.
ALIKE = 4, 5
#: Characters of a candidate group from which it is cut, and shingles compared with one document at once.
BLOCK_CHARS, COMPARED_AT_ONCE = 8 << 20, 1 << 22


def similar_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of sets (of different numbers each) with the same connected components as all pairs at `ALIKE` or more.

    Every pair is compared exactly, unless its sizes exclude it or earlier pairs have connected it.
    """
    by = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in by], dtype=np.int64)
    ends = np.cumsum(sizes)
    _, flat = np.unique(np.concatenate([sets[i] for i in by] or [np.zeros(0)]), return_inverse=True)
    mine = np.zeros(int(flat.max(initial=-1)) + 1, dtype=np.int64)
    label = np.arange(len(by))
    pairs = []

    def alike(row: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` (sets before the row) that are near copies of the row; its members are marked in `mine`."""
        found = []
        for some in np.array_split(others, max(1, -(-int(sizes[others].sum()) // COMPARED_AT_ONCE))):
            if not len(some):
                continue
            starts = np.cumsum(sizes[some]) - sizes[some]
            at = np.arange(int(sizes[some].sum())) + np.repeat(ends[some] - sizes[some] - starts, sizes[some])
            common = np.add.reduceat(mine[flat[at]], starts)
            found.append(some[ALIKE[1] * common >= ALIKE[0] * (sizes[some] + sizes[row] - common)])
        return np.concatenate(found) if found else others

    for row in range(len(by)):
        low = np.searchsorted(sizes, max(1, -(-ALIKE[0] * sizes[row] // ALIKE[1])))
        if low >= row:
            continue
        members = flat[ends[row] - sizes[row] : ends[row]]
        mine[members] = 1
        labels = label[low:row]
        _, first = np.unique(labels, return_index=True)  # one of every component, then the others where it is unlike
        near = alike(row, first + low)
        rest = ~np.isin(labels, label[near])
        rest[first] = False
        near = np.r_[near, alike(row, np.flatnonzero(rest) + low)]
        mine[members] = 0
        if len(near):
            pairs += [(int(by[row]), int(by[j])) for j in near[np.unique(label[near], return_index=True)[1]]]
            label[np.isin(label, label[near])] = label[row]
    return pairs


def confirmed_edges(df: DataFrame, candidates: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Edges (a, b) between nodes whose sets of shingles have similarity `ALIKE` or more.

    candidates: component, node and a row (doc_id, text_key) of `df` with the node's shingles. All members of a
    component are compared. Only texts of components with several nodes move.
    """
    shared = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    named = candidates.join(shared.select("component"), "component", "left_semi").select(
        "component", "node", F.coalesce("doc_id", F.lit(NULL_ID)).alias("__doc"), F.col("text_key").alias("__key")
    )
    rows = df.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__doc"), F.xxhash64("text").alias("__key"), "text")
    texts = settled(rows.join(named, ["__doc", "__key"]).dropDuplicates(["__doc", "__key"]).select("component", "node", "text"))
    chars = texts.groupBy("component").agg(F.sum(F.length("text")).alias("chars"))
    large = chars.where(F.col("chars") > block_chars)  # at most all characters / block_chars
    cuts = F.ceil(F.coalesce("chars", F.lit(1)) / block_chars).cast("int")
    sized = texts.join(F.broadcast(large), "component", "left").withColumn("cuts", cuts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _whole_groups(batches, ["component", "part"]):
            for _, group in groups.groupby(["component", "part"], sort=False):
                pairs = similar_pairs([np.unique(shingle_hashes(t, WIDE_SHINGLE)) for t in group["text"]])
                node = group["node"].to_numpy()
                yield pd.DataFrame({"a": node[[a for a, _ in pairs]], "b": node[[b for _, b in pairs]]}, dtype=np.int64)

    parts = _cut(sized).select("component", "part", "node", "text")
    return parts.repartition("component", "part").sortWithinPartitions("component", "part", "node").mapInPandas(run, EDGE)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The largest value of every register of a slice, batch by batch."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, packed in zip(batch["slice"], batch["registers"], strict=True):
            values = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
            held[at] = np.maximum(held[at], values) if at in held else values
    yield pd.DataFrame({"slice": list(held), "registers": [zlib.compress(v.tobytes(), 1) for v in held.values()]})


def commonness(df: DataFrame) -> np.ndarray:
    """For each cell of shingles about four times the binary logarithm of the number of different sets it stands in.

    Every set writes its own rank into one register of its shingles' cells and the largest stays, so copies count
    once. The result has CELLS bytes at any size of the corpus. It only orders shingles and says which groups to cut;
    shingles that share a cell, or an estimate that is off, cost time but no link.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        registers = np.zeros((REGISTERS, CELLS), dtype=np.uint8)
        for batch in batches:
            for text in batch["text"]:
                hashes = np.unique(shingle_hashes(text, WIDE_SHINGLE))
                name = int(mixed(np.array([set_name(hashes)], dtype=np.uint64))[0])
                mine, cells, rest = registers[name % REGISTERS], _cells(hashes), name // REGISTERS | 1 << 60
                mine[cells] = np.maximum(mine[cells], (rest & -rest).bit_length())
        if registers.any():
            slices = [registers[:, at : at + SLICE].tobytes() for at in range(0, CELLS, SLICE)]
            yield pd.DataFrame({"slice": range(len(slices)), "registers": [zlib.compress(v, 1) for v in slices]})

    form = "slice int, registers binary"
    parts = df.select("text").mapInPandas(run, form).withColumn("some", F.spark_partition_id() % MERGED_AT_ONCE)
    some = parts.repartition("slice", "some").select("slice", "registers").mapInPandas(_merged, form)
    common = np.zeros(CELLS, dtype=np.uint8)
    for row in some.repartition("slice").mapInPandas(_merged, form).collect():  # CELLS * REGISTERS bytes at most
        values = np.frombuffer(zlib.decompress(row["registers"]), dtype=np.uint8).reshape(REGISTERS, -1)
        common[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = values.sum(axis=0)
    return common


def rare_shingles(df: DataFrame, common: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, part, node: every set with the first fifth, plus one, of its shingles from rare to common.

    A shingle of about more than `block_rows` sets is cut, and every two cuts meet in one part. A set is given once
    for each partition of `df` at most, however many copies it has there.
    """
    sets = 0.3 * REGISTERS * 2.0 ** (common / REGISTERS)
    cuts_of = 1 + (np.maximum(0, sets - np.median(sets)) // block_rows).astype(np.int64)
    shared = df.sparkSession.sparkContext.broadcast((common, cuts_of))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, cuts_of = shared.value
        seen: set[int] = set()
        for batch in batches:
            keys, parts, nodes = [], [], []
            for text in batch["text"]:
                hashes = np.unique(shingle_hashes(text, WIDE_SHINGLE))
                name = set_name(hashes)
                if name in seen or not len(hashes):
                    continue
                seen.add(name)
                cells = _cells(hashes)
                first = len(hashes) - -(-ALIKE[0] * len(hashes) // ALIKE[1]) + 1
                chosen = np.lexsort((hashes, common[cells]))[:first]
                cuts = cuts_of[cells[chosen]]
                own = (np.uint64(name) % cuts.astype(np.uint64)).astype(np.int64)
                at = np.repeat(np.arange(first), cuts)
                other = np.arange(len(at)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                keys.append(hashes[chosen][at])
                parts.append(np.minimum(own[at], other) * cuts[at] + np.maximum(own[at], other))
                nodes.append(np.full(len(at), name, dtype=np.uint64))
            if keys:
                key, node = np.concatenate(keys).view(np.int64), np.concatenate(nodes).view(np.int64)
                yield pd.DataFrame({"key": key, "part": np.concatenate(parts), "node": node})

    return df.select("text").mapInPandas(run, "key bigint, part bigint, node bigint")


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The groups of two or more nodes among rows sorted by key, part and node; a group that comes again goes."""
    seen: set[int] = set()
    for rows in _whole_groups(batches, ["key", "part"]):
        key, part, node = (rows[c].to_numpy() for c in ("key", "part", "node"))
        new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        fresh = new | np.r_[True, node[1:] != node[:-1]]
        new, node = new[fresh], node[fresh]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(node)]
        many = ends - starts > 1
        found = []
        for start, end in zip(starts[many], ends[many], strict=True):
            members = node[start:end].tobytes()
            name = xxhash.xxh64_intdigest(members)
            if name not in seen:
                seen.add(name)
                found.append((node[start], name - 2**63, members))
        if found:
            yield pd.DataFrame(found, columns=["least", "name", "members"])


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        nodes = [np.frombuffer(m, dtype=np.int64) for m in batch["members"]]
        if nodes:
            sizes = np.array([len(n) for n in nodes])
            again = {c: np.repeat(batch[c].to_numpy(), sizes) for c in ("least", "name")}
            yield pd.DataFrame(again | {"size": np.repeat(sizes, sizes), "node": np.concatenate(nodes)})


def _near(prints: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, row) within the radius among the rows of one group."""
    first = np.arange(0, len(prints), 64)
    counts = np.minimum(64, len(prints) - first)
    planes = _planes(prints, first, counts)
    for some in np.array_split(queries, max(1, -(-len(queries) * len(first) // PAIRS_AT_ONCE))):
        query, block = np.repeat(some, len(first)), np.tile(np.arange(len(first)), len(some))
        mask = near_masks(prints[query], planes[block], counts[block], radius)
        on = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, lane = np.nonzero(on)
        yield query[pair], first[block[pair]] + lane


def _sifted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate edges of groups that stand together by `least`, the largest first.

    Small groups are compared many at a time. In a large one, rows that earlier groups of the same least node have
    connected are not compared with each other again: only rows outside the largest part ask all others.
    """
    last, parent = None, {}

    def root(node: int) -> int:
        while parent.setdefault(node, node) != node:
            parent[node] = node = parent[parent[node]]
        return node

    for rows in _whole_groups(batches, ["least", "name"]):
        small = rows[rows["size"] <= LARGE]
        if len(small):
            prints = np.frombuffer(b"".join(small["print"]), dtype="<u8").reshape(len(small), -1)
            at = small[["least", "name"]].to_numpy()
            group = np.r_[0, np.cumsum((at[1:] != at[:-1]).any(axis=1))]
            a, b = links(prints, group, WIDE_RADIUS)
            node = small["node"].to_numpy()
            yield pd.DataFrame({"a": node[a], "b": node[b]})
        for (least, _), group in rows[rows["size"] > LARGE].groupby(["least", "name"], sort=False):
            if least != last:
                last, parent = least, {}
            node = group["node"].to_numpy()
            prints = np.frombuffer(b"".join(group["print"]), dtype="<u8").reshape(len(group), -1)
            label = np.array([root(n) for n in node.tolist()])
            names, sizes = np.unique(label, return_counts=True)
            if sizes.max() == 1:
                a, b = links(prints, np.zeros(len(node), dtype=np.int64), WIDE_RADIUS)
                pairs = np.column_stack([node[a], node[b]])
            else:
                queries = np.flatnonzero(label != names[sizes.argmax()])
                met = [np.unique(np.column_stack([label[q], label[r]]), axis=0) for q, r in _near(prints, queries, WIDE_RADIUS)]
                pairs = np.concatenate([np.zeros((0, 2), dtype=np.int64), *met])
            edges = []
            for a, b in pairs.tolist():
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((a, b))
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"])


def candidate_edges(df: DataFrame, classes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) with the components of all pairs of sets that share a rare shingle and lie within the radius.

    classes: `node` and `print`, a row for each set of shingles of `df`.
    """
    rare = rare_shingles(df, commonness(df), block_rows)
    rare = rare.repartition("key", "part").sortWithinPartitions("key", "part", "node")
    met = rare.mapInPandas(_meetings, "least bigint, name bigint, members binary").dropDuplicates(["name"])
    rows = met.mapInPandas(_members, "least bigint, name bigint, size bigint, node bigint").join(classes, "node")
    rows = rows.repartition("least").sortWithinPartitions("least", F.desc("size"), "name", "node")
    return rows.select("least", "name", "size", "node", "print").mapInPandas(_sifted, EDGE)


def deduplicated(df: DataFrame) -> DataFrame:
    """The rows of `df` without near copies: of each group the row with the smallest doc_id (and text hash) stays.

    Documents are near copies at a similarity (Jaccard) of 0.8 or more of their sets of five-word shingles.
    Fingerprints of 256 bits only sift candidates; every link is confirmed on the shingles. Rows that repeat are near
    copies, too, and so are all texts without a word. An empty table gives an empty one; columns of any name pass.
    """
    df_id, df_key = _unused("doc", df), _unused("key", df)
    prints = settled(fingerprints(df, WIDE_SHINGLE, SEED, WIDE, distinct=True))
    row = F.struct("doc_id", "text_key")
    classes = settled(prints.groupBy("node").agg(F.min(row).alias("row"), F.first("print").alias("print")))
    edges = candidate_edges(df.select("text"), classes.select("node", "print"))
    candidates = classes.select("node", "row.*").join(connected(edges), "node")
    linked = connected(confirmed_edges(df, candidates))
    placed = classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = placed.groupBy("component").agg(F.min("row").alias("kept")).select("kept.*")
    kept = kept.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(df_id), F.col("text_key").alias(df_key))
    rows = df.withColumn(df_id, F.coalesce("doc_id", F.lit(NULL_ID))).withColumn(df_key, F.xxhash64("text"))
    return rows.join(kept, [df_id, df_key], "left_semi").dropDuplicates([df_id, df_key]).drop(df_id, df_key)


def _unused(name: str, df: DataFrame) -> str:
    """`name` with as many leading underscores as no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
