"""The Merkle manifest and suffix-array dedup, against brute force and DuckDB."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from drawlens.llm import batches, merkle, suffixes
from drawlens.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(leaves, arity=2):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def leaf(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def audited(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    root = top[-1][0]
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            x, siblings = leaf(r, int(tampered)), ""
            for levels, j in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    run = level[j // 2 * 2 : j // 2 * 2 + 2]
                    before, after = "".join(run[: j % 2]), "".join(run[j % 2 + 1 :])
                    siblings, x, j = siblings + before + after, h(before + x + after), j // 2
            yield (r["doc_id"], leaf(r), trees[g][-1][0], root, h(siblings), x, x == root)


ROWS = "doc_id bigint, source string, lang string, n_chars bigint, text string, root int, tree int, grp string, c0 int, no int"


def rows_of(n, langs, seed=0):
    r = random.Random(seed)
    out = [(i, "s", r.choice(langs), i % 5, f"text {i}", 1, 2, "g", 3, 4) for i in range(n)]
    out += [(None, None, None, None, None, 1, 2, "g", 3, 4)] * 2 + [(3, "s", "", 1, "", 1, 2, "g", 3, 4)] * 3 + [(7, "Ä", "é", 2, "ü" * 4000, 1, 2, "g", 3, 4), (-8, "s", "zz", None, "x", 1, 2, "g", 3, 4)]
    return out


@pytest.mark.parametrize("block", [3, 16, merkle.BLOCK])
@pytest.mark.parametrize("langs", [["en"], ["en", None, "de", "é", ""], [f"l{i}" for i in range(90)]])
def test_audit_equals_brute_force(spark, block, langs):
    rows = rows_of(150, langs)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = sorted(repr(tuple(r)) for r in merkle.audit(df, block=block).collect())
    assert got == sorted(map(repr, audited([dict(zip([c.split()[0] for c in ROWS.split(", ")], r, strict=True)) for r in rows])))


@pytest.mark.parametrize("n", [1, 2, 3, 26, 28, 81])
def test_proofs_of_other_arities(spark, n):
    leaves = [h(str(i)) for i in range(n)]
    df = spark.createDataFrame([(i, "g", x, "kept") for i, x in enumerate(leaves)], "merkle int, grp string, leaf string, note string")
    got = merkle.prove(df, "merkle", "grp", carry=("note",), arity=3, block=4).collect()
    own = tree(leaves, 3)
    root = tree([own[-1][0]], 3)[-1][0]
    assert len(got) == n and {r["_merkle"]["root"] for r in got} == {root} and {r["note"] for r in got} == {"kept"}
    for r in got:
        x = leaves[r["merkle"]]
        assert r["_merkle"]["leaf"] == x and r["_merkle"]["position"] == r["merkle"]
        for step in r["_merkle"]["proof"]:
            x = h(step["before"] + x + step["after"])
        assert x == root


def test_one_row_and_none(spark):
    one = [(5, "s", "en", 1, "t", 1, 2, "g", 3, 4)]
    got = merkle.audit(spark.createDataFrame(one, ROWS)).collect()
    assert len(got) == 1 and got[0]["leaf"] == got[0]["root"] == got[0]["subroot"] and got[0]["proof_sha256"] == h("")
    assert merkle.audit(spark.createDataFrame([], ROWS)).collect() == []


def test_merging_forests_is_associative():
    r = random.Random(1)
    leaves = [h(str(i)).encode() for i in range(37)]
    whole = tree([x.decode() for x in leaves])
    parts = [[(0, 0, i, 37, leaves[i])] for i in range(37)]
    while len(parts) > 1:
        a, b = (parts.pop(r.randrange(len(parts))) for _ in range(2))
        forest = merkle.Forest(1, 2)
        forest.add(a + b)
        parts.append([(*key, forest.size[key[0]], x) for key, x in forest.live.items()])
    assert [x[4].decode() for x in parts[0]] == whole[-1]


def removed(rows, length=50):
    texts, least = [(i, (t or "").encode()) for i, t in rows], {}
    for i, b in texts:
        for p in range(len(b) - length + 1 if i is not None else 0):
            least[b[p : p + length]] = min(i, least.get(b[p : p + length], i))
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield (i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())


@pytest.fixture(scope="module")
def passages(texts):
    r = random.Random(5)
    line = texts[41]
    cut = [texts[0][: r.randrange(40, 200)] + texts[1][r.randrange(30) :] for _ in range(30)]
    extra = ["a " * 300, "b" * 400, "b" * 49, "b" * 50, "ab" * 200, line * 3, *cut, *[str(i) * 3 + line + str(i) * 60 for i in range(40)]]
    return [*enumerate([*texts, *extra]), (None, line), (3, texts[0]), (3, line * 2), (-5, line[10:90])]


@pytest.mark.parametrize("options", [{}, {"fan": 1}, {"hot_from": 2, "sample_bits": 0}, {"hot_from": 2, "sample_bits": 0, "fan": 1}])
def test_suffixes_equal_brute_force(spark, passages, options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in passages], "doc_id bigint, text string, doc int, repeats string").repartition(3)
    assert sorted(repr(tuple(r)) for r in suffixes.kept_digest(df, **options).collect()) == sorted(map(repr, removed(passages)))


def test_suffixes_carry_columns_and_other_lengths(spark, passages):
    rows = [(i, t, 1, "x") for i, t in passages]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, doc int, repeats string")
    for length in (16, 20, 52):
        got = suffixes.remove_earlier(df, length=length, carry=("repeats", "doc")).collect()
        assert {(r["repeats"], r["doc"]) for r in got} == {("x", 1)}
        own = [(r["doc_id"], r["_repeats"]["n_bytes"], sum(s["end"] - s["start"] for s in r["_repeats"]["removed"]), len(r["_repeats"]["removed"]), hashlib.sha256(r["_repeats"]["kept"]).hexdigest()) for r in got]
        assert sorted(map(repr, own)) == sorted(map(repr, removed(passages, length)))


def test_suffixes_of_nothing_and_odd_ids(spark):
    assert suffixes.kept_digest(spark.createDataFrame([], "doc_id int, text string")).collect() == []
    with pytest.raises(ValueError):
        suffixes.kept_digest(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    got = suffixes.kept_digest(spark.createDataFrame([(2, "y" * 60), (1, "y" * 60)], "`doc.id` smallint, text string"), "doc.id").collect()
    assert {(r[0], r["n_removed"]) for r in got} == {(1, 0), (2, 60)}


def test_multikey_sort_and_anchors():
    r = np.random.default_rng(0)
    data = r.integers(97, 99, (500, 16), dtype=np.uint8)
    order, same = suffixes.multikey_order(np.zeros(500, np.int64), suffixes._word(data), 2)
    own = [bytes(data[i]) for i in order]
    assert own == sorted(own) and same.tolist() == [False] + [a == b for a, b in zip(own, own[1:], strict=False)]
    text = bytes(r.integers(97, 100, 700, dtype=np.uint8))
    buffer, _ = suffixes.joined([text, text])
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    hashes = suffixes._grams(eight)
    got = suffixes._anchors(hashes, 1351, 50)
    for i in range(0, 1351, 7):
        high = (hashes[i : i + 35] >> np.uint64(32)).tolist()
        assert got[i] == i + high.index(min(high))
    assert batches.FAN > 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_suffix_dedup"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(oracle_sql()[name])
    got = queries()[name](spark, SF)
    assert [c[0] for c in cursor.description] == got.columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, cursor.fetchall()))
