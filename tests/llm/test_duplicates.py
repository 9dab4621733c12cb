"""SimHash, components and substring removal against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from postloom.llm import simhash, substring
from postloom.llm.components import connected


def plain_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(values, radius):
    return [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= radius]


def flipped(value, bits):
    for b in bits:
        value ^= 1 << b
    return value


def family(choose, n, copies):
    seeds = [choose.getrandbits(63) for _ in range(n)]
    return sorted({*seeds, *(flipped(s, choose.sample(range(63), choose.randint(1, 5))) for s in seeds for _ in range(copies))})


def test_fingerprint():
    words = "Ab cd\tEF é gh".split()
    lowered = ["ab", "cd", "ef", "é", "gh"]
    hashes = [xxhash.xxh64_intdigest(" ".join(lowered[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert int(simhash.fingerprint(" ".join(words))[0]) == want
    assert int(simhash.fingerprint("Ab cd")[0]) == xxhash.xxh64_intdigest("ab cd", 42)
    assert not simhash.fingerprint(None)[0] and not simhash.fingerprint(" \n")[0]
    wide = simhash.fingerprint("a b c d e", width=4)
    assert len(wide) == 4 and wide[0] == simhash.fingerprint("a b c d e")[0]


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_links(radius):
    choose = random.Random(radius)
    values = np.array(family(choose, 60, 4), dtype=np.uint64)
    groups = np.sort(np.array([choose.randint(0, 3) for _ in values]))
    a, b = simhash.links(values[:, None], groups, radius)
    nodes = range(len(values))
    want = [(i, j) for i in nodes for j in nodes if i < j and groups[i] == groups[j]
            and (int(values[i]) ^ int(values[j])).bit_count() <= radius]
    assert plain_components(nodes, want) == plain_components(nodes, zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_linked_fingerprints(spark, block_rows):
    """Small blocks cut even these groups, so every pair of parts has to meet."""
    choose = random.Random(8)
    base = choose.getrandbits(63)
    values = family(choose, 80, 3) + [flipped(base, choose.sample(range(20), 2)) for _ in range(60)]
    values = sorted(set(values))
    rows = spark.createDataFrame([(v, bytes(np.uint64(v).tobytes())) for v in values], "node bigint, print binary")
    edges = simhash.linking_edges(rows, simhash.band_pairs(3), 3, block_rows)
    found = plain_components(values, [(r.a, r.b) for r in edges.collect()])
    assert found == plain_components(values, near(values, 3))


def test_connected(spark):
    choose = random.Random(2)
    edges = [(choose.randint(0, 150), choose.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(200, 240)]
    nodes = {n for a, b in edges for n in (a, b) if a != b}
    found = connected(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.component for r in found.collect()} == {
        n: c for n, c in plain_components(nodes, [e for e in edges if e[0] != e[1]]).items()
    }
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_of_texts(texts):
    rows = texts((5, "one two three four"), (3, "one two three four"), (9, None), (8, ""), (None, "ONE two three four"),
                 (1, "other words stand here now"))
    found = simhash.near_duplicates(simhash.fingerprints(rows), simhash.band_pairs(3)).collect()
    assert {r.doc_id: r.component_id for r in found} == {5: 3, 3: 3, 9: 8, 8: 8, None: 3, 1: 1}
    empty = simhash.near_duplicates(simhash.fingerprints(texts().limit(0)), simhash.band_pairs(3))
    assert empty.count() == 0


def test_deduplicated_keeps_one_of_a_group(texts):
    choose = random.Random(4)
    word = lambda: "".join(choose.choice("abcdefgh") for _ in range(5))
    originals = [[word() for _ in range(300)] for _ in range(25)]
    rows = [(100 + i, " ".join(o)) for i, o in enumerate(originals)]
    rows += [(200 + i, " ".join([*o[:150], "new", *o[151:]])) for i, o in enumerate(originals[:10])]
    rows += [(100, " ".join(originals[0])), (300, None), (301, "")]
    kept = simhash.deduplicated(texts(*rows))
    assert kept.columns == ["doc_id", "text", "part", "rank"]
    assert sorted(r.doc_id for r in kept.collect()) == [*range(100, 125), 300]


def test_links_have_the_similarity(texts):
    """Of 300 different words every exchanged one costs five shingles: 6 leave a similarity of 0.816, 7 of 0.788."""
    choose = random.Random(9)
    word = lambda: "".join(choose.choice("abcdefgh") for _ in range(7))
    rows, linked = [], 0
    for i in range(60):
        words = [word() for _ in range(300)]
        changed = 6 if i % 2 else 7
        linked += i % 2
        other = [word() if k % 40 == 20 and k < 40 * changed else w for k, w in enumerate(words)]
        rows += [(i, " ".join(words)), (100 + i, " ".join(other))]
    line = [word() for _ in range(10)]  # repeated, so that it makes up most shingles of two unlike documents
    rows += [(200 + i, " ".join([*(line * 60), *(word() for _ in range(80))])) for i in range(2)]
    kept = {r.doc_id for r in simhash.deduplicated(texts(*rows)).collect()}
    assert linked == 30 and kept == {i for i, _ in rows} - {100 + i for i in range(1, 60, 2)}


def alike(sets, numerator=4, denominator=5):
    nodes = range(len(sets))
    return [(i, j) for i in nodes for j in nodes
            if i < j and denominator * len(sets[i] & sets[j]) >= numerator * len(sets[i] | sets[j]) > 0]


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_candidates_lose_no_link(spark, texts, block_rows):
    """Texts of 5 to 300 words beside a line that all of them hold; small blocks cut the groups of that line."""
    choose = random.Random(12)
    word = lambda: "".join(choose.choice("abcdefgh") for _ in range(6))
    line, rows = [word() for _ in range(12)], []
    for size in (5, 6, 7, 9, 12, 20, 40, 80, 300):
        for _ in range(6):
            words = [word() for _ in range(size)]
            rows += [words] + [[word() if choose.random() < rate else w for w in words] for rate in (0, 0.01, 0.02, 0.04, 0.06)]
            rows += [[*words, word()], [*line, *words], [*line, *words[1:]]]
    rows = [" ".join(r) for r in rows] + [None, ""]
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in rows]
    df = texts(*enumerate(rows))
    prints = simhash.fingerprints(df, 5, width=simhash.WIDE, distinct=True)
    classes = prints.groupBy("node").agg(F.first("print").alias("print"))
    edges = [(r.a, r.b) for r in simhash.candidate_edges(df, classes, block_rows).collect()]
    names = {s: int(np.uint64(simhash.set_name(np.array(sorted(s), dtype=np.uint64))).view(np.int64)) for s in sets}
    found = plain_components(set(names.values()), edges)
    links = alike(sets)
    assert len(links) > 200 and all(found[names[sets[a]]] == found[names[sets[b]]] for a, b in links)
    kept = {r.doc_id for r in simhash.deduplicated(df).collect()}
    parts = plain_components(range(len(rows)), [*links, (len(rows) - 2, len(rows) - 1)])
    assert kept == set(parts.values())


def test_large_groups_are_sifted_once():
    """Two groups of one least node: the second repeats the first but for a few rows, of which one links."""
    choose = random.Random(6)
    base = [choose.getrandbits(64) for _ in range(4)]
    near = lambda n: [flipped(base[0], choose.sample(range(64), 6)), *(b ^ choose.getrandbits(4) for b in base[1:])][:n]
    prints = {i: near(4) for i in range(400)} | {i: [choose.getrandbits(64) for _ in range(4)] for i in range(400, 403)}
    prints[403] = near(4)
    size = {1: range(402), 2: [*range(0, 399), 402, 403]}
    rows = [(0, name, len(size[name]), i, np.array(prints[i], dtype="<u8").tobytes()) for name in (1, 2) for i in size[name]]
    frame = pd.DataFrame(rows, columns=["least", "name", "size", "node", "print"])
    edges = []
    for at in range(0, len(frame), 100):  # batches end inside groups
        edges.append(frame.iloc[at : at + 100])
    found = [(a, b) for part in simhash._sifted(iter(edges)) for a, b in part.itertuples(index=False)]
    parts = plain_components(prints, found)
    assert parts == {i: 0 if i < 400 or i == 403 else i for i in prints}
    assert len(found) == 400


def test_commonness_counts_sets_not_copies(spark, texts):
    choose = random.Random(7)
    word = lambda: "".join(choose.choice("abcdefgh") for _ in range(6))
    line, copy = [word() for _ in range(8)], " ".join(word() for _ in range(30))
    rows = [(i, copy) for i in range(600)]
    rows += [(1000 + i, " ".join([*line, *(word() for _ in range(20))])) for i in range(600)]
    common = simhash.commonness(texts(*rows))
    of = lambda text: common[simhash._cells(simhash.shingle_hashes(text, 5))].mean()
    assert of(" ".join(line)) > of(copy) + 15
    assert not simhash.commonness(texts().limit(0)).any()


def test_near_dedup_passes_columns_of_its_own_names(spark):
    rows = [(1, "a b c d e f", 7, 8, 9), (1, "a b c d e f", 7, 8, 9), (None, None, 1, 2, 3), (4, "", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, doc int, key int, __key int")
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == [(1, "a b c d e f", 7, 8, 9), (None, None, 1, 2, 3)]
    assert simhash.deduplicated(df.limit(0)).count() == 0


def test_one_group_of_ten_thousand_short_texts(spark, texts):
    """Every text exchanges one of 60 words: all are near copies of each other, and one is unlike them."""
    choose = random.Random(5)
    word = lambda: "".join(choose.choice("abcdefgh") for _ in range(7))
    words = [word() for _ in range(60)]
    rows = [(i, " ".join([*words[:at], word(), *words[at + 1 :]])) for i, at in enumerate([0, 59] * 5000)]
    rows.append((20000, " ".join(word() for _ in range(60))))
    assert sorted(r.doc_id for r in simhash.deduplicated(texts(*rows)).select("doc_id").collect()) == [0, 20000]


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_are_all_connected(seed):
    choose = random.Random(seed)
    sets = [set()]
    for _ in range(12):
        first = choose.sample(range(4000), choose.randint(1, 60))
        sets += [{*choose.sample(first, max(1, len(first) - choose.randint(0, 9))), *choose.sample(range(4000), 2)} for _ in range(9)]
    found = simhash.similar_pairs([np.array(sorted(s), dtype=np.uint64) for s in sets])
    nodes = range(len(sets))
    want = [(i, j) for i in nodes for j in nodes if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    assert plain_components(nodes, found) == plain_components(nodes, want)


def test_groups_in_cuts_are_confirmed(spark, texts):
    """With a bound of a few texts every two cuts of a candidate group still meet."""
    choose = random.Random(3)
    word = lambda: "".join(choose.choice("abcdefgh") for _ in range(7))
    words = [word() for _ in range(200)]
    rows = [(i, " ".join([word() if k == 3 * i else w for k, w in enumerate(words)])) for i in range(30)]
    rows += [(50, " ".join(word() for _ in range(200)))]
    df = texts(*rows)
    candidates = df.select(F.lit(1).cast("bigint").alias("component"), F.col("doc_id").alias("node"), "doc_id",
                           F.xxhash64("text").alias("text_key"))
    edges = [(r.a, r.b) for r in simhash.confirmed_edges(df, candidates, block_chars=5000).collect()]
    found = plain_components([i for i, _ in rows], edges)
    assert found == {**dict.fromkeys(range(30), 0), 50: 50}


def plain_removal(rows, window):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words, cut = text.split(), set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                cut.update(range(i, i + window))
            seen.add(key)
        out[doc] = " ".join(w for i, w in enumerate(words) if i not in cut) if cut else text
    return out


def test_repeats_are_removed(texts):
    choose = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    passage = [choose.choice(words) for _ in range(45)]
    rows = []
    for i in range(40):
        text = [choose.choice(words) for _ in range(choose.randint(0, 120))]
        if i % 3 == 0:
            at = choose.randint(0, len(text))
            start = choose.randint(0, 15)
            text = [*text[:at], *passage[start : start + 30], *text[at:]]
        rows.append((i, " ".join(text)))
    rows += [(50, rows[3][1]), (51, " ".join(["same"] * 70))]
    found = {r.doc_id: r.text for r in substring.deduplicated(texts(*rows)).collect()}
    assert found == plain_removal(rows, 20)


def test_removal_edge_cases(texts):
    line = " ".join(map(str, range(50)))
    rows = texts((1, line), (1, line), (2, f"x  {line}"), (3, None), (4, ""), (None, f"{line} y"), (5, "a  b"))
    found = sorted(((r.doc_id or 0, r.text, r.n_removed) for r in substring.deduplicated(rows).collect()), key=repr)
    # The null id comes first, so it keeps the passage; both rows of document 1 are one document.
    assert found == sorted([(0, f"{line} y", 0), (1, "", 50), (1, "", 50), (2, "x", 50), (3, None, 0), (4, "", 0),
                            (5, "a  b", 0)], key=repr)
    carried = substring.deduplicated(rows, carry=["part", "rank"])
    assert {(r.part, r["rank"]) for r in carried.collect()} == {("x", 7)}
    assert substring.digests(texts().limit(0)).count() == 0
    assert substring.digests(rows).where(F.col("n_removed") > F.col("n_words")).count() == 0
