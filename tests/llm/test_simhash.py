"""SimHash links against all pairs, compared outright."""

import re

import numpy as np
import xxhash

from pairlens.llm.queries import QUERIES
from pairlens.llm.simhash import near_duplicates, trie_join


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    label = {f: min(i for i, g in prints if g == f) for _, f in prints}
    moved = True
    while moved:
        moved = False
        for f in label:
            low = min(label[g] for g in label if (f ^ g).bit_count() <= 2)
            if low < label[f]:
                label[f], moved = low, True
    return sorted((i, f"{f:016x}", label[f]) for i, f in prints)


def test_query_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op1_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect())
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(tuple(r) for r in near_duplicates(odd_docs).collect())
    assert got == plain([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert near_duplicates(no_docs).collect() == []


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    more = np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base ^ flips, base ^ flips ^ more]))
    x, y = trie_join(np.zeros(len(prints), dtype=np.int64), np.zeros(len(prints), dtype=bool), prints)
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(int(a), int(b)) for i, a in enumerate(prints) for b in prints[i + 1 :] if int(a ^ b).bit_count() <= 2}
    assert got == want


def test_depths_agree(spark, monkeypatch):
    from pairlens.llm import simhash

    docs = spark.range(3000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 30), i -> concat('w', pmod(hash(id div 3, i), 500))), 'end', pmod(id, 3)) AS text")
    want = sorted(tuple(r) for r in near_duplicates(docs).collect())
    monkeypatch.setattr(simhash, "NODE_ROWS", 40)
    assert sorted(tuple(r) for r in near_duplicates(docs).collect()) == want


def test_populous_prefix_is_cut_deeper(spark, monkeypatch):
    """Most fingerprints share long prefixes; a node pair holds few of them all the same."""
    from pairlens.llm import simhash
    from pairlens.llm.common import Written, components

    rng = np.random.default_rng(5)
    near = [sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) ^ 0x5555 << 40 for _ in range(400)]
    prints = sorted({*near, *(int(x) for x in rng.integers(0, 2**63, 100))})
    monkeypatch.setattr(simhash, "NODE_ROWS", 32)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in prints], "fp long")
    written = Written(spark)
    found = simhash.node_pairs(df, 2, written)
    assert len(found) > 4 and sum(p.count() for _, p in found) > 0
    got = {int(np.int64(r.node).astype(np.uint64)): r.root for r in components(simhash.links(df, written), written).collect()}
    label = {f: f for f in prints}
    moved = True
    while moved:
        moved = False
        for f in prints:
            low = min(label[g] for g in prints if (f ^ g).bit_count() <= 2)
            if low < label[f]:
                label[f], moved = low, True
    groups = {}
    for f in prints:
        groups.setdefault(label[f], set()).add(f)
    mine = {}
    for f in prints:
        mine.setdefault(got.get(f, int(np.uint64(f).astype(np.int64))), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
