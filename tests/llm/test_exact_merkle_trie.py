"""Exact dedup by fuse filters, Merkle manifest and prefix trie, against plain versions of what they compute."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import exact_dedup, merkle, prefix_trie


# Exact dedup


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5000, 200_000])
def test_fuse_filter_knows_all_keys_and_few_others(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    fuse = exact_dedup.build_fuse(keys)
    assert exact_dedup.in_fuse(fuse, keys).all()
    others = np.random.default_rng(1).integers(1 << 63, (1 << 64) - 1, 100_000, dtype=np.uint64)
    assert exact_dedup.in_fuse(fuse, others).mean() < 0.006
    if n >= 5000:
        assert len(fuse.prints) < 1.35 * n


def weak(text):
    """A digest of which only one byte tells texts apart."""
    return F.unhex(F.concat(F.substring(F.sha2(text, 256), 1, 2), F.lit("00" * 31)))


def copies_by_hand(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept_one = False
        for i in ids:
            kept = i == keep and not kept_one
            kept_one |= kept
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def copied_rows():
    rng = random.Random(3)
    texts = [f"text {k}  of\tit" for k in range(60)] + ["", " ", "\n", "x" * 200_000, "é\x0b\x0cé", "é é"]
    rows = [(i, rng.choice(texts)) for i in range(400)]
    rows += [(1000 + i, "the  common \n one") for i in range(200)]
    rows += [(None, "none"), (None, "none"), (7, None), (2000, "twice"), (2000, "twice"), (2000, "twice "), (None, "twice")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("digest", [exact_dedup._sha256, weak])
@pytest.mark.parametrize("batches", [1, 4])
def test_copies(spark, copied_rows, batches, digest):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in copied_rows], "doc_id long, text string, row int, digest string").repartition(6)
    got = exact_dedup.find_copies(docs, batches, digest)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == copies_by_hand(copied_rows)


def test_all_texts_in_one_bucket_of_bytes_are_told_apart(spark, monkeypatch, copied_rows):
    """Beyond the bound of a broadcast the result is the same."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(copied_rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.find_copies(docs, 3, weak)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == copies_by_hand(copied_rows)


def test_screening_passes_each_known_digest(spark):
    rows = [(i % 7, b, hashlib.sha256(f"{i}".encode()).digest()) for b in range(3) for i in range(b * 1000, b * 1000 + 1500)]
    buckets = spark.createDataFrame(rows, "bucket int, batch int, digest binary")
    got = exact_dedup.screen(buckets, exact_dedup.build_filters(buckets))
    known = {(r["digest"], r["batch"], r["snapshot"]) for r in got.collect()}
    held = defaultdict(set)
    for _, batch, digest in rows:
        held[batch].add(bytes(digest))
    for later in range(3):
        for earlier in range(later):
            assert {(d, later, earlier) for d in held[later] & held[earlier]} <= {(bytes(d), b, s) for d, b, s in known}
    assert len(known) < 2 * 500 + 60 and all(s < b for _, b, s in known)


def test_kept_documents(spark, copied_rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in copied_rows], "doc_id long, text string, kept int")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    want = sorted(((i, sha) for i, _, _, kept, sha in copies_by_hand(copied_rows) if kept), key=repr)
    sha = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    assert sorted((tuple(r) for r in left.select("doc_id", sha).collect()), key=repr) == want
    assert exact_dedup.find_copies(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


# Merkle manifest


def hexed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduced(level):
    """(levels of a tree) by the plain rule."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([hexed(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest_by_hand(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    leaf = lambda r: hexed(*(value(r[i]) for i in (0, 1, 2, 3, 4)))
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda n: b"" if n is None else b"+" + n.encode())
    levels = {n: reduced([x[2] for x in sorted(trees[n], key=lambda x: x[:3])]) for n in names}
    top = reduced([levels[n][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for pos, (_, _, h, r) in enumerate(sorted(trees[name], key=lambda x: x[:3])):
            siblings, folded = [], h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                folded = leaf((*r[:3], r[3] + 1, r[4]))
            for place, tree in ((pos, levels[name]), (at, top)):
                for level in tree[:-1]:
                    run = level[place & ~1 : (place & ~1) + 2]
                    if len(run) == 2:
                        sibling = run[1 - (place & 1)]
                        siblings.append(sibling)
                        folded = hexed(sibling, folded) if place & 1 else hexed(folded, sibling)
                    else:
                        folded = hexed(folded)
                    place >>= 1
            out.append((r[0], h, levels[name][-1][0], hexed(*siblings), folded))
    return sorted(out, key=repr), top[-1][0]


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 8, 9])
def test_van_emde_boas_addresses(levels):
    depth = np.concatenate([np.full(1 << d, d) for d in range(levels)])
    index = np.concatenate([np.arange(1 << d) for d in range(levels)])
    at = merkle.veb_address(depth, index, levels)
    assert sorted(at.tolist()) == list(range((1 << levels) - 1)) and at[0] == 0
    # Every lower subtree lies in one piece behind the upper half.
    upper = levels // 2
    if upper:
        lower = (1 << (levels - upper)) - 1
        tree = np.where(depth >= upper, index >> np.maximum(depth - upper, 0), -1)
        for t in range(1 << upper):
            own = np.sort(at[tree == t])
            assert own.tolist() == list(range((1 << upper) - 1 + t * lower, (1 << upper) - 1 + (t + 1) * lower))


def some_documents(n, seed, langs):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", None, "bé"]), rng.choice(langs), rng.choice([None, 5, 70]), rng.choice(["", None, "täxt", f"t{i}"])) for i in range(n)]
    return rows + [(None, None, None, None, None)] * 2 + [(3, "again", langs[0], 1, "x"), (3, "again", langs[0], 1, "x")]


@pytest.mark.parametrize("height", [1, 2, 8])
@pytest.mark.parametrize("n", [1, 9, 70])
def test_manifest(spark, n, height):
    rows = some_documents(n, n, ["en", "en", "en", "de", "", "ü", "zz"])
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    proofs, root = merkle.write_manifest(docs.repartition(4), tamper=("n_chars", tampered), height=height)
    want, want_root = manifest_by_hand(rows)
    assert root.hex() == want_root
    assert sorted((tuple(r) for r in proofs.collect()), key=repr) == want


def test_manifest_of_one_group_and_of_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    rows = [(i, "s", "en", i, "t" * (i % 5)) for i in range(600)]
    proofs, root = merkle.write_manifest(spark.createDataFrame(rows, schema))
    want, want_root = manifest_by_hand([(*r[:3], r[3], r[4]) for r in rows])
    assert root.hex() == want_root
    got = {r["doc_id"]: r for r in proofs.collect()}
    # Nothing is tampered with, so every proof leads to the root.
    assert all(r["folded_root"] == want_root for r in got.values())
    assert {i: r["proof_sha256"] for i, r in got.items()} == {w[0]: w[3] for w in want}
    proofs, root = merkle.write_manifest(spark.createDataFrame([], schema))
    assert proofs.count() == 0 and root is None
    proofs, root = merkle.write_manifest(spark.createDataFrame(rows[:1], schema))
    row = proofs.first()
    assert row["leaf"] == row["subroot"] == row["folded_root"] == root.hex() and row["proof_sha256"] == hexed("")


# Prefix trie


def rebuilt_by_hand(rows):
    """rows: conv_id, turn, role, text; ties of turns do not occur here."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def trie_by_hand(rebuilt):
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = own + sum(saved[c] for c in children[path])
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    turns = [("user", "hi"), ("bot", "hällo"), ("user", ""), (None, "x"), ("", "x"), ("user", None), ("sys", "long " * 50)]
    rows = []
    for c in [*range(-7, 90), 10**15]:
        n = 0 if c == 10 else rng.choice([1, 2, 3, 5, 9, 12])
        for t in range(n):
            role, text = turns[0] if t < 2 and rng.random() < 0.8 else rng.choice(turns)
            rows.append((c, t if t else None, role, text))
    for c in range(1000, 1200):  # the same conversation many times
        rows += [(c, 1, "sys", "rules"), (c, 2, "user", "go")]
    rows += [(2000, t, "user", str(t % 3)) for t in range(700)]
    rows += [(None, 1, "user", "nobody")]
    rng.shuffle(rows)
    return rows


def spark_trie(spark, rows, cells, most=1 << 16):
    schema = "conv_id long, turn long, role string, text string, block string, path int"
    convs = spark.createDataFrame([(*r, "b", 1) for r in rows], schema)
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    rebuilt = prefix_trie.branched(prefix_trie.turns_of(convs), F.col("conv_id") - F.col("conv_id") % 5, shared, 8)
    return prefix_trie.prefix_trie(rebuilt, cells, most)


@pytest.mark.parametrize("cells, most", [(1, 1), (40, 1000), (200, 3), (1 << 20, 1 << 16)])
def test_trie(spark, talks, cells, most):
    got = spark_trie(spark, talks, cells, most)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_by_hand(rebuilt_by_hand(talks))


def test_long_pieces_of_ends(spark, monkeypatch):
    rows = [(c * 5, 1, "user", "same") for c in range(3000)]
    got = spark_trie(spark, rows, 1 << 12)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_by_hand(rebuilt_by_hand(rows))


def test_conversations_without_turns_and_no_conversations(spark):
    # Conversations whose own turns all lie before the cut and whose base is not there have none.
    rows = [(c, 1, "user", "a") for c in (1, 2, 3, 4, 6)]
    got = spark_trie(spark, rows, 1 << 10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_by_hand(rebuilt_by_hand(rows))
    assert spark_trie(spark, [(None, 1, "user", "a")], 1 << 10).count() == 0


def test_equal_numbers_and_repeated_rows(spark):
    rows = [(5, 1, "a", "x"), (5, 1, "b", "y"), (5, 1, "a", "x"), (10, 1, "b", "y"), (10, 1, "a", "x"), (10, 1, "a", "x")]
    schema = "conv_id long, turn long, role string, text string"
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, schema))
    sequences = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in turns.collect()}
    assert sequences[5] == sequences[10] and len(sequences[5]) == 3
