"""Manifest, proofs and folded roots against a plain tree."""

import hashlib
import random
import zlib

import pytest

from wardlight.llm import merkle
from wardlight.llm.queries import LLM_QUERIES

MEDIUM = "/root/testdata/sf0.01"
COLUMNS = list(merkle.COLUMNS)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes):
    """Top digest and each node's proof as a list of ``(before, after)`` by plain recursion on levels."""
    proofs, owner = [[] for _ in nodes], list(range(len(nodes)))
    level = nodes
    while len(level) > 1:
        for i, at in enumerate(owner):
            run = at // 8 * 8
            proofs[i].append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
            owner[i] = at // 8
        level = [h("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
    return level[0], proofs


def plain(docs):
    """``docs`` are tuples in the order of ``COLUMNS``."""
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append((d[0] is None, d[0] or 0, leaf_of(d), d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree_of([leaf for _, _, leaf, _ in sorted(groups[g], key=lambda r: r[:3])]) for g in names]
    root, upper = tree_of([t[0] for t in trees])
    out = []
    for g, (subroot, proofs), above in zip(names, trees, upper):
        for (_, _, leaf, d), proof in zip(sorted(groups[g], key=lambda r: r[:3]), proofs):
            path, node = proof + above, leaf
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and d[4] is not None:
                node = leaf_of((*d[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[4])))
            for before, after in path:
                node = h(before + node + after)
            out.append((d[0], leaf, subroot, root, h("".join(a + b for a, b in path)), node, node == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_equals_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select(*COLUMNS).collect()]
    found = LLM_QUERIES["op11_merkle"](spark, MEDIUM)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert order(found.collect()) == order(plain(docs))


@pytest.mark.parametrize("height", [1, 2])
def test_several_sweeps(make, height):
    docs = [(i, "s", f"l{i % 11 if i > 700 else 0}", i, f"Text {i}") for i in range(800)]
    frame = make(docs, "doc_id long, source string, lang string, n_chars long, text string")
    assert len(merkle.manifest(frame, height=height).groups.rounds) == {1: 4, 2: 2}[height]
    assert order(merkle.tampering(frame, height=height).collect()) == order(plain(docs))


def test_edge_rows(make):
    schema = "doc_id long, source string, lang string, n_chars long, text string, Leaf int, tree string, digest string"
    docs = [
        (1, "s", "en", 3, "ABC"), (1, "s", "en", 3, "ABC"), (1, "s", "en", 4, "ABD"), (None, None, None, None, None), (None, "s", "en", 1, "X"),
        (3, "", "", 0, ""), (6, "s", "é", 2, "Éa"), (9, "s", "en", 1, "A" * 200000), (-5, "s", "=", None, "Q"), (1 << 62, "s", "en", 1, "Z"),
    ]
    frame = make([(*d, 1, "t", "d") for d in docs], schema)
    assert order(merkle.tampering(frame).collect()) == order(plain(docs))
    empty = make([], schema)
    assert merkle.tampering(empty).count() == 0 and merkle.manifest(empty).root.count() == 0
    alone = [(7, "s", "en", 1, "x")]
    assert order(merkle.tampering(make([(*alone[0], 1, "t", "d")], schema)).collect()) == order(plain(alone))


def test_proofs_lead_to_the_root(make):
    docs = [(i, "s", "en" if i % 3 else None, i, f"t{i}") for i in range(100)]
    made = merkle.manifest(make(docs, "doc_id long, source string, lang string, n_chars long, text string"))
    rows = merkle.proofs(made).collect()
    assert len(rows) == 100
    for r in rows:
        assert merkle.fold(r.leaf, (r.places, r.beside)) == r.root
        assert merkle.fold(h("other"), (r.places, r.beside)) != r.root


def test_queue_holds_few_messages():
    rng = random.Random(1)
    for total in [1, 2, 8, 9, 63, 64, 65, 513, 4096]:
        leaves = [h(str(rng.random())) for _ in range(total)]
        top, proofs = tree_of(leaves)
        queue_sizes = []
        push = merkle.LabelQueue.send

        def send(self, label, message):
            push(self, label, message)
            queue_sizes.append(len(self.heap))

        merkle.LabelQueue.send = send
        try:
            found, _ = merkle.sweep_up(leaves, merkle.height_of(total))
        finally:
            merkle.LabelQueue.send = push
        assert found == top
        assert max(queue_sizes, default=0) <= merkle.FAN * merkle.HEIGHT
        down = dict(merkle.sweep_down(leaves, merkle.height_of(total), ([], [])))
        assert all("".join(down[i][1]) == "".join(a + b for a, b in proof) for i, proof in enumerate(proofs))
