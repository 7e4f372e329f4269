import zlib
from hashlib import sha256

import pytest

from pageloom.llm import merkle
from tests.llm.odd import COLUMNS, no_documents, odd_documents


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = r["n_chars"] + more if r["n_chars"] is not None else None
    return h(*map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def proven(nodes):
    """Root of a list of nodes, and for each the siblings with their side, upward."""
    paths, at, where = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        for k, p in enumerate(where):
            other = p ^ 1
            paths[k].append((other < p, at[other] if other < len(at) else ""))
        at = [h(*at[k : k + 2]) for k in range(0, len(at), 2)]
        where = [p // 2 for p in where]
    return (at or [None])[0], paths


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subs[lang] = proven([leaf(r) for r in trees[lang]])
    root, upper = proven([subs[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for r, path in zip(trees[lang], subs[lang][1], strict=True):
            path = path + upper[k]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf(r, 1 if hit else 0)
            for left, other in path:
                now = h(other, now) if left else h(now, other)
            out.append((r["doc_id"], leaf(r), subs[lang][0], root, h(*[o for _, o in path]), now, now == root))
    return sorted(out, key=repr)


def got(docs, **more):
    return sorted((tuple(r) for r in merkle.verified(merkle.manifest(docs, **more)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("levels", [2, 3, 12])
def test_manifest_against_plain_trees(spark, levels):
    rows = [(k * 7 % 97, f"text {k} " * (k % 5), ["en", "de", None, "", "é"][k % 7 % 5] if k < 80 else "en", f"s{k % 3}", k if k % 4 else None) for k in range(97)]
    docs = spark.createDataFrame([*rows, (500, "alone", "zz", "s", 5)], COLUMNS).repartition(5)
    want = plain([r.asDict() for r in docs.collect()])
    assert got(docs, levels=levels) == want
    assert {r[-1] for r in want} == {True, False}


def test_odd_rows(spark):
    docs = odd_documents(spark, [(2**62, "far", "en", "a", 2**63 - 1), (-5, "below", None, "a", -1)])
    want = plain([r.asDict() for r in docs.collect()])
    assert got(docs, levels=2) == want and len(want) == 13
    assert got(no_documents(spark)) == []


def test_a_tree_over_many_ranges_keeps_its_order(spark):
    docs = spark.range(3000).selectExpr("id * 31 % 3000 AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars").repartition(6)
    want = plain([r.asDict() for r in docs.collect()])
    assert got(docs, levels=4) == want


def test_sweeps_of_one_block():
    leaves = [(k, h(str(k))) for k in range(5)]
    known = merkle.forward(leaves, 5, 0, 3)
    paths = merkle.backward(known, 0, 3, 0, "")
    root, want = proven([d for _, d in leaves])
    assert known[3, 0] == root and all(merkle.folded(d, paths[k]) == root for k, d in leaves)
    assert [[(s == "L", d) for s, d in merkle.siblings(paths[k])] for k in range(5)] == want
