"""The pipeline against its stages' plain versions, one after the other."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import gpt, plain_fingerprint, plain_groups


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(20)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = say(60)
    rows, labels = [], []
    for i in range(300):
        words = say(rng.randint(60, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), "vilest" + rng.choice(["a", "um", "or"]))
        text = " ".join(words)
        if i % 7 == 1:
            text = text[:100] + " " + shared + " " + text[100:]
        if i % 11 == 2:
            text = say(20)  # too short
        if i % 13 == 3:
            text = rows[i - 2][1]  # a copy
        if i % 17 == 4 and not toxic:
            text += " tail"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int("vilest" in text)))
    rows.append((400, None, None, None, None))
    root = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels[:250], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


def plain_base(text):
    w = (text or "").encode().split()
    g = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w) >= 50 and 100 * len(hit) <= 50 * len(w)


def plain_cut(rows, width=50):
    first, out = {}, []
    for k, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first.setdefault(b[i : i + width], k) < k:
                gone[i : i + width] = b"\1" * width
        out.append((k, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def test_pipeline(spark, corpus):
    from tokenizers import Tokenizer

    root, rows = corpus
    got = corpus_pipeline.run(spark, root).collect()
    kept = [(r[0], r[1]) for r in rows if "vilest" not in (r[1] or "")]
    kept = [(k, t) for k, t in kept if plain_base(t)]
    groups = plain_groups([(k, plain_fingerprint(t)) for k, t in kept])
    firsts = {c for _, _, c in groups}
    cleaned = plain_cut([(k, t) for k, t in kept if k in firsts])
    plain = Tokenizer.from_str(gpt())
    want = collections.Counter()
    for k, t in cleaned:
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            want[(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids))] += 1
    assert len(cleaned) > 100
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want


def test_stages_keep_the_columns(spark, corpus):
    root, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, root).dtypes == docs.dtypes, name
        assert stage(spark, empty, root).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, root).count() == 0
