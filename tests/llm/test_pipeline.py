"""The pipeline on documents with nulls, empties, copies, clashing columns; every stage against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from drawlens.llm import toxicity
from drawlens.llm.queries import tokenizer

SCHEMA = "doc_id bigint, text string, lang string, n_chars bigint, n_words string, kept_text int, node string, own_node int, score double, `a.b` int"
ITEM = "Which colour has the deep sea at noon of a bright day. The sea is blue and very cold"


def rows():
    r = random.Random(21)
    prose = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    shared = prose(60)
    texts = [prose(r.randrange(1, 150)) for _ in range(40)]
    texts += [f"{prose(30)} {shared}\n{prose(20)}" for _ in range(4)]
    texts += [texts[0]] * 3 + [texts[1] + " more", None, None, "", " \t ", "ÄÖ ü\x1c x", "w1", prose(5000)]
    texts += [f"{prose(40)} {ITEM.upper()}! {prose(30)}", f"{prose(20)} vileword {prose(20)}"]
    texts += [f"{prose(25)} {'vileword nasty' if i % 2 else ''} {prose(10)}" for i in range(80)]
    out = [(i, t, "en", len(t) if t else None, "x", 1, "y", 2, 0.5, 3) for i, t in enumerate(texts)]
    return [*out, out[5], (None, texts[7], None, 1, None, None, None, None, None, None)], {len(texts) - 80 + i: i % 2 for i in range(80)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    own, labels = rows()
    spark.createDataFrame(own, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels.items(), (None, 1), (3, None)], "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_equal_brute_force(spark, folder, components):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    whole = [tuple(r) for r in docs.collect()]
    stages = dict(p.STAGES)

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {(r["doc_id"], r["predicted"]) for r in toxicity.score_documents(docs, model).collect()}
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.schema == docs.schema and Counter(map(repr, map(tuple, clean.collect()))) == Counter(repr(r) for r in whole if (r[0], 1) not in toxic)
    assert 40 <= sum(y for _, y in toxic) <= 43

    own = [tuple(r) for r in clean.collect()]
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})((t or "").encode().lower().split())
    sets = [shingles(r[1]) for r in own]
    group = components(len(own), lambda a, b: own[a][0] is not None and own[b][0] is not None and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = Counter()
    for g in set(group):
        members = [r for r, x in zip(own, group, strict=True) if x == g]
        kept[repr(min(members, key=lambda r: (r[0] is None, r[0] or 0)))] += 1
    near = stages["simhash_near_dedup"](spark, clean, folder)
    assert near.schema == docs.schema and Counter(map(repr, map(tuple, near.collect()))) == kept

    own = [tuple(r) for r in near.collect()]
    words = [(r[1] or "").encode().split() for r in own]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = Counter()
    for r, w in zip(own, words, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        text = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if gone.any() else r[1]
        expected[repr((r[0], text, r[2], None if text is None else len(text), *r[4:]))] += 1
    passages = stages["substring_dedup"](spark, near, folder)
    assert passages.columns == columns and Counter(map(repr, map(tuple, passages.collect()))) == expected and sum(len(w) for w in words) > sum(len((r[1] or "").split()) for r in passages.collect())

    left = stages["benchmark_decontamination"](spark, passages, folder)
    assert left.columns == columns and Counter(map(repr, map(tuple, left.collect()))) == Counter(repr(tuple(r)) for r in passages.collect() if ITEM.upper() not in (r["text"] or ""))

    tiktoken = pytest.importorskip("tiktoken")
    from drawlens.llm import bpe

    path, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(path))}, special_tokens={})
    rows_ = []
    for r in left.collect():
        ids = library.encode_ordinary(r["text"] or "")
        rows_.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert Counter(rows_) == Counter(tuple(r) for r in stages["byte_bpe"](spark, left, folder).collect()) == Counter(tuple(r) for r in p.run(spark, folder).collect())


def test_stages_of_an_empty_table(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
