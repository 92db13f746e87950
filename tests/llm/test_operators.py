"""Operators against plain versions on small tables with odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from scholium.llm import ann, bpe, ngram_quality, packing, quality_rules, sharding, simhash, suffix_dedup, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank long, key string"


def words(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "Élan", "straße", "語", "x1", "the"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Odd texts: NULL, empty, blank, long without spaces, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(1)
    shared = words(rng, 40)
    base = words(rng, 120)
    texts = [None, "", " \t\n", "one", "one two", base, base, base.replace("lorem", "lorem2", 1), base + " tail", shared + " a b c",
             "start " + shared, "mid " + shared[7:200] + " end", "x" * 3000, "ab" * 400, "a a a a a a " * 60, "é" * 60 + "z", "é" * 60 + "y",
             "l1\nl1\n \nl2\nl1", "# $ % & | < > *", "\u00a0x\u2003y  z\r\n\x0bq\x0c r", "it's  we'll\n\n  x" * 5]
    texts += [words(rng, rng.randint(1, 90)) for _ in range(40)]
    out = [(i * 3, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, 1, 2, "k") for i, t in enumerate(texts)]
    return out + [out[5], out[9], (None, base, "en", None, None, 1, 2, "k")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(t):
    return (t or "").encode().split()


def test_quality_rules(spark, docs, rows, none):
    def measures(t):
        w = tokens(t)
        g = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if tokens(x)]
        return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit),
                len(w) < 50 or 100 * len(hit) > 50 * len(w))

    got = quality_rules.judge(docs).collect()
    want = collections.Counter((r[0], *measures(r[1])) for r in rows)
    assert collections.Counter((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.keep_good(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_bad_host_takes_its_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    table = [(i, good if i % 10 else bad, "ok") for i in range(200)] + [(500 + i, bad if i % 10 else good, "farm") for i in range(200)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(table, "doc_id long, text string, source string")).collect()}
    assert sum(got[i] for i in range(200)) == 180
    assert not any(got[500 + i] for i in range(200))


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    """Smallest key of each key's component, over (key, fingerprint) pairs."""
    distinct = sorted(set(f for _, f in fps))
    up = {f: f for f in distinct}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                up[top(a)] = top(b)
    least = {}
    for k, f in fps:
        if k is not None:
            least[top(f)] = min(k, least.get(top(f), k))
    return [(k, f, least.get(top(f))) for k, f in fps]


def test_simhash(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    want = plain_groups([(r[0], plain_fingerprint(r[1])) for r in rows])
    assert collections.Counter((r["key"], r["fp"] % 2**64, r["component"]) for r in got) == collections.Counter(want)
    assert simhash.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_first(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in want})


@pytest.mark.parametrize("cell", [4096, 16, 2])
def test_links_in_crowded_cells(spark, cell):
    """Many fingerprints in one cell, dealt as pairs of blocks or not, give the components of all pairs."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    half = rng.getrandbits(32)
    fps |= {half << 32 | rng.getrandbits(32) for _ in range(60)}
    for f in list(fps):
        g = f
        for _ in range(rng.randint(0, 3)):
            for _ in range(rng.randint(1, 4)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["node"]: r["label"] for r in simhash.components(simhash.links(table, cell=cell)).collect()}
    want = plain_groups([(i, f) for i, f in enumerate(fps)])
    by_label = collections.defaultdict(set)
    for i, _, c in want:
        by_label[c].add(signed[i])
    assert {frozenset(x) for x in by_label.values() if len(x) > 1} == {
        frozenset(x) for x in _grouped(got).values()
    }


def test_a_shared_half_costs_no_pairs(spark):
    """Fingerprints with a common half, and those that only visit a cell nobody owns, are not all compared."""
    rng = random.Random(13)
    half = rng.getrandbits(32) | 1 << 31
    fps = sorted({half << 32 | rng.getrandbits(32) for _ in range(3000)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    plan = simhash.links(table, cell=64)
    got = {frozenset(x) for x in _grouped({r["node"]: r["label"] for r in simhash.components(plan).collect()}).values()}
    want = collections.defaultdict(set)
    for i, _, c in plain_groups(list(enumerate(fps))):
        want[c].add(signed[i])
    assert got == {frozenset(x) for x in want.values() if len(x) > 1}


def _grouped(labels):
    out = collections.defaultdict(set)
    for node, label in labels.items():
        out[label].add(node)
    return out


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(100)] + [(5, 5), (7, 6), (200, 300)]
    got = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 300: 200}


URLS = ["http://A.Example.com/en/7?x", "https://example.com/en/71", "http://x.com/en/", "http://xcom/en/", "http://com/en/q#f", "http://a.net/de/8",
        "http://example.net/de/8", "http://b.example.net/de/81?", "http://w.org/es/", "http://w.org/e", "ftp://u@h.org:80/es/x", "nothing", "", None,
        "a://b://c/en/", "://", "http://www.spam-farm.example.org/q", "http://h\n.com/en/x\ny?z", "http://ÀB.com/en/"]


def plain_url(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "block" if host in listed else "allow"))
    return host, path, rule, verdict


def picked(host):
    return host != "" and hashlib.md5(host.encode()).hexdigest()[0] in url_filters.LISTED_DIGITS


def test_url_filters(spark):
    urls = URLS + URLS[:3] + ["http://" + "x." * 40_000 + "com/en/" + "y" * 100_000]
    pages = spark.createDataFrame([(i, u, "r", 1, 2) for i, u in enumerate(urls)], "page_id long, url string, rule string, l0 int, block int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.judge(pages, url_filters.listed_hosts(pages)).collect()}
    listed = {h for h in (plain_url(u, ())[0] for u in urls) if picked(h)}
    assert listed
    assert got == {i: plain_url(u, listed) for i, u in enumerate(urls)}
    assert url_filters.judge(pages.limit(0), url_filters.listed_hosts(pages)).count() == 0
    clash = url_filters.judge(pages, url_filters.listed_hosts(pages), keep=["page_id", "l0", "block"])
    assert clash.columns[:3] == ["page_id", "l0", "block"] and clash.count() == len(urls)


@pytest.mark.parametrize("block", [url_filters.BLOCK, 100])
def test_cascade_is_exact(spark, block):
    """Each level errs often, yet all levels of a block together never do, however many blocks there are."""
    universe = spark.range(20000).selectExpr("concat('h', id % 15000) key").union(spark.sql("select cast(null as string)"))
    listed = spark.range(0, 30000, 7).selectExpr("concat('h', id) key")
    cascade = url_filters.build_cascade(universe, listed, block=block)
    assert len(cascade.hashes) > 3
    assert cascade.blocks == (1 if block > 4000 else 22)
    got = cascade.marked(universe, "key", "listed")
    assert got.count() == 20001
    assert got.where("listed != coalesce(cast(substring(key, 2) as int) % 7 = 0, false)").count() == 0
    none = url_filters.build_cascade(universe, listed.limit(0))
    assert none.marked(universe, "key", "listed").where("listed").count() == 0


def test_the_query_needs_several_levels(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    hosts = pages.select(url_filters.host_of(pages["url"]).alias("key"))
    assert len(url_filters.build_cascade(hosts, url_filters.listed_hosts(pages).withColumnRenamed("host", "key")).hashes) > 1


def plain_repeats(rows, width=50):
    last = float("inf")
    texts = [(last if k is None else k, (t or "").encode()) for k, t in rows]
    first = {}
    for k, b in sorted(texts):
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], k)
    for k, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < k:
                gone[i : i + width] = b"\1" * width
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        yield None if k == last else k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def passages(seed):
    """Texts over a tiny alphabet with long repeats, shared ends and inner repeats."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 160))) for _ in range(12)]
    return [(rng.randrange(60), "".join(rng.choice(pool)[rng.randint(0, 9) :] for _ in range(rng.randint(1, 6)))) for _ in range(80)]


@pytest.mark.parametrize("case", ["odd", "passages", "hot", "small blocks"])
def test_suffix_dedup(spark, rows, case, monkeypatch):
    table = [(r[0], r[1]) for r in rows] if case == "odd" else passages(2)
    if case == "hot":
        monkeypatch.setattr(suffix_dedup, "MANY", 2)
        monkeypatch.setattr(suffix_dedup, "HOT", 1)
    if case == "small blocks":
        monkeypatch.setattr(suffix_dedup, "BLOCK", 100)
        monkeypatch.setattr(suffix_dedup, "GATHER", 40)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    if case != "odd":  # patched constants hold in this process only
        docs = docs.coalesce(1)
    got = collections.Counter(tuple(r) for r in suffix_dedup.digests(docs).collect())
    assert got == collections.Counter(plain_repeats(table))


@pytest.mark.parametrize("many, hot, block, gather", [(32, 2048, 1 << 19, 600_000), (2, 1, 1 << 19, 600_000), (2, 0, 90, 50), (32, 4, 64, 40)])
def test_suffix_passes_in_process(many, hot, block, gather, monkeypatch):
    """The three passes without Spark, with every way of dealing rows."""
    import pyarrow as pa

    for name, value in (("MANY", many), ("HOT", hot), ("BLOCK", block), ("GATHER", gather)):
        monkeypatch.setattr(suffix_dedup, name, value)
    if gather < 1000:
        monkeypatch.setattr(suffix_dedup, "HELD", 3)
    for seed in range(4):
        table = sorted({k: t for k, t in passages(seed)}.items())
        texts = {k: t.encode() for k, t in table}
        blocks = []
        for part in (table[::2], table[1::2]):
            batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([texts[k] for k, _ in part]), pa.array([0] * len(part))], ["k", "data", "t"])
            blocks += suffix_dedup._cells(50, 20, 7)(iter([batch]))
        rows = pa.Table.from_batches(suffix_dedup._opened(iter(blocks))).sort_by([("h", "ascending"), ("c", "ascending"), ("k", "ascending")])
        found = pa.Table.from_batches(suffix_dedup._reduced(iter(rows.to_batches(max_chunksize=17)))).to_pylist()
        asked = collections.defaultdict(list)
        spans = collections.defaultdict(list)
        for r in found:
            (asked if r["ask"] else spans)[r["k"]].append(r["span"])
        batch = pa.RecordBatch.from_arrays([pa.array(list(asked), pa.int64()), pa.array([texts[k] for k in asked]), pa.array([0] * len(asked)), pa.array(list(asked.values()), pa.list_(pa.int64()))], ["k", "data", "t", "asked"])
        cells = pa.Table.from_batches(suffix_dedup._asked(50, 20)(iter([batch]))).sort_by("h").combine_chunks()
        for r in pa.Table.from_batches(suffix_dedup._settled(50)(iter(cells.to_batches(max_chunksize=13)))).to_pylist():
            spans[r["k"]].append(r["span"])
        got = []
        for k, b in texts.items():
            starts, ends = suffix_dedup.merged(spans[k])
            got.append((k, len(b), int((ends - starts).sum()), len(starts), hashlib.sha256(suffix_dedup._kept(b, starts, ends)).hexdigest()))
        assert got == list(plain_repeats(table))


def test_remove_repeats(docs, rows, none):
    cleaned = suffix_dedup.remove_repeats(docs)
    assert cleaned.columns == docs.columns
    got = cleaned.collect()
    assert len(got) == len(rows)
    assert sum(r["text"] is None for r in got) == sum(r[1] is None for r in rows)
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.digests(none).count() == 0


def test_suffix_dedup_of_extreme_keys_and_names(spark):
    """The largest key, NULL keys with many texts, and columns of any name."""
    shared = words(random.Random(9), 30)
    table = [(1, shared, "a"), (2**63 - 1, "x" + shared, "b"), (None, "y" + shared, "c"), (None, shared + "z", "d"), (None, None, "e"), (5, "", "f"), (5, shared, "g")]
    for names in (["k", "text", "_k"], ["_key", "_data", "_spans"], ["t", "none", "row"], ["rest", "data", "none"]):
        docs = spark.createDataFrame(table, f"`{names[0]}` long, `{names[1]}` string, `{names[2]}` string")
        got = collections.Counter(tuple(r) for r in suffix_dedup.digests(docs, names[0], names[1]).collect())
        assert got == collections.Counter(plain_repeats([r[:2] for r in table]))
        cleaned = suffix_dedup.remove_repeats(docs, names[0], names[1])
        assert cleaned.columns == names
        assert {r[2]: r[1] for r in cleaned.collect()} == {"a": shared, "b": "x", "c": "y", "d": "z", "e": None, "f": "", "g": ""}


def multi():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def test_bpe(docs, rows, none):
    import tiktoken

    ranks = bpe.load_ranks(multi())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encoded(docs, multi(), public_tokenizers.PATTERN)
    want = collections.Counter((r[0], np.array(plain.encode_ordinary(r[1] or ""), "<u4").tobytes()) for r in rows)
    assert collections.Counter((r["key"], bytes(r["ids"])) for r in got.collect()) == want
    back = bpe.decoded(got, multi(), public_tokenizers.PATTERN).collect()
    assert collections.Counter((r["key"], bytes(r["decoded"])) for r in back) == collections.Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert bpe.round_trip(none, multi(), public_tokenizers.PATTERN).count() == 0


def test_bpe_on_random_bytes():
    import tiktoken

    ranks = bpe.load_ranks(multi())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(multi(), public_tokenizers.PATTERN), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab e\n\t  '’.,1٣語é\u00a0\u2028\x1c\x85") for _ in range(rng.randint(0, 60)))
        assert codec.encode(text) == np.array(plain.encode_ordinary(text), "<u4").tobytes(), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_shard_fill_is_the_heap():
    import heapq

    rng = random.Random(4)
    for _ in range(30):
        loads = [rng.randrange(5000) for _ in range(7)]
        size, count = rng.randint(1, 300), rng.randint(0, 2000)
        heap = [(x, j) for j, x in enumerate(loads)]
        heapq.heapify(heap)
        want = [0] * 7
        for _ in range(count):
            x, j = heapq.heappop(heap)
            want[j] += 1
            heapq.heappush(heap, (x + size, j))
        after = list(loads)
        assert sharding.fill(after, size, count) == want
        assert after == [x + n * size for x, n in zip(loads, want, strict=True)]


def test_sharding(docs, rows, none):
    got = sharding.shard(docs, shards=5).collect()
    assert collections.Counter((r["key"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, homes = collections.defaultdict(list), collections.defaultdict(set)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        homes[text[r["key"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard(none).count() == 0


def test_sharding_of_a_hot_group_and_ties(spark):
    table = [(i, "hot " * 50 if i % 3 == 0 else f"text {i % 500:05d}") for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(table, "doc_id long, text string"), shards=4).collect()
    loads = collections.Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    small = sorted(loads.values())[:3]
    assert small[-1] - small[0] <= max(r["size"] for r in got) * 6  # the hot group fills a shard alone


def gpt():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(gpt())
    got = packing.pack(docs, gpt(), window=256).collect()
    want = collections.Counter()
    for r in rows:
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 256):
            want[(r[0], a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()), len(ids))] += 1
    assert collections.Counter((r["key"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 256) + 1
    assert packing.pack(none, gpt()).count() == 0


def test_best_fill_is_best():
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(5)}
        room = rng.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + i * length for s in sums for i in range(n + 1) if s + i * length <= room}
        fill = packing.best_fill(counts, room)
        assert sum(k * n for k, n in fill.items()) == max(sums)
        assert all(0 < n <= counts[k] for k, n in fill.items())


def test_plan_uses_everything():
    rng = random.Random(7)
    histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(30)}
    used = collections.Counter()
    for times, fill in packing.plan(histogram, 64):
        assert sum(k * n for k, n in fill.items()) <= 64
        for k, n in fill.items():
            used[k] += times * n
    assert used == histogram


def test_tokens_as_the_library_gives_them():
    """Every whole token of the vocabulary, and special strings as their own tokens."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(gpt())
    own = packing.Tokens(gpt())
    texts = [plain.decode([i]) for i in range(0, 50256, 7)] + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>  y", "a  b", " a", "a ", "a\n b", "a \nb\n \nc"]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8))
    vectors = [(centres[i % 20] + 0.3 * rng.normal(size=8)).astype("f4").tolist() for i in range(600)]
    vectors[40:60] = [vectors[0]] * 20  # one common vector
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 7 + [None]), (1004, [float("inf")] * 8), (None, vectors[1])]
    table = spark.createDataFrame([*enumerate(vectors), *odd, (3, vectors[3])], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(table, table["vec_id"] % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    assert sorted(got) == list(range(0, 600, 20))
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        score = [math.fsum(a * b for a, b in zip(vectors[q], v, strict=True)) for v in vectors]
        assert all(v != q and abs(s - score[v]) < 1e-12 for _, v, s in found)
        assert [(v, s) for _, v, s in found] == sorted(((v, s) for _, v, s in found), key=lambda x: (-x[1], x[0]))
        hits += len({v for _, v, _ in found} & set(sorted((v for v in range(600) if v != q), key=lambda v: (-score[v], v))[:20]))
    assert hits >= 0.9 * 20 * len(got)
    assert ann.search(table.where("vec_id >= 1000"), table["vec_id"] % 20 == 0).count() == 0
    few = table.where("vec_id < 5")
    assert ann.search(few, few["vec_id"] == 0).count() == 4


@pytest.mark.parametrize("at_a_time", [1 << 16, 3])
def test_neighbours_of_repeated_keys_and_short_vectors(spark, at_a_time, monkeypatch):
    """A key with several vectors has one place in a ranking, by its nearest pair; short vectors are filled up."""
    monkeypatch.setattr(ann, "QUERIES", at_a_time)
    rng = random.Random(8)
    table = [(rng.randrange(12), [float(rng.randint(-3, 3)) for _ in range(rng.choice([2, 3]))]) for _ in range(60)]
    table = [(i, v) for i, v in table if any(v)]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(vectors, vectors["vec_id"] % 2 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in {i for i, _ in table if i % 2 == 0}:
        score = {}
        for i, v in table:
            for j, w in table:
                if i == q != j:
                    score[j] = max(score.get(j, -math.inf), sum(a * b for a, b in zip(v, w)))
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert got[q] == [(n, j, s) for n, (j, s) in enumerate(best, 1)]


def test_recall_of_the_registered_query(spark):
    """Against brute force over all vectors of a test table."""
    import os

    import duckdb

    from scholium.llm import queries

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = [(i, v) for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall() if v is not None and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found = {(r["query_id"], r["vec_id"]) for r in queries.op10_approximate_nearest_neighbours(spark, sf).collect()}
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        near = [j for j in np.lexsort((ids, -(x @ x[i]))) if ids[j] != ids[i]][:20]
        hits += sum((ids[i], ids[j]) in found for j in near)
        total += len(near)
    assert len(found) == total
    assert hits >= 0.9 * total


def test_quality_model_adds_up():
    """Probabilities of all bytes after any context add up to 1, however counts were sharded."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcde ") for _ in range(3000)).encode()
    g, n = np.unique(ngram_quality.grams(np.frombuffer(text, np.uint8), 3), return_counts=True)
    d = np.array([0.0, 0.5, 0.8, 1.2])
    lower, now = [], g
    for m in (2, 1):
        now, k = np.unique(now & ((1 << 8 * m) - 1), return_counts=True)
        lower.insert(0, ngram_quality.table(now, k, d))
    shard = ngram_quality.Shard(3, 0, 1 << 24, ngram_quality.table(g, n, d), lower)
    for context in (b"ab", b"a\xff", b"\xff\xfe"):
        every = (context[0] << 16 | context[1] << 8) + np.arange(256)
        assert np.exp(shard.log_probability(every)).sum() == pytest.approx(1)


@pytest.mark.parametrize("shard", [2_000_000, 40])
def test_quality_classifier(spark, docs, none, shard):
    rng = random.Random(9)
    table = [(i, words(rng, 80), "en") for i in range(60)] + [(100 + i, "".join(rng.choice("%$#@!^&*QXZJ") for _ in range(300)), "en") for i in range(20)]
    table += [(200, None, "en"), (201, "ab", "fr"), (202, words(rng, 50), None), (202, words(rng, 50), None), (3, table[3][1], "en")]
    texts = spark.createDataFrame(table, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(100, 0), (None, 1)], "doc_id long, quality int")
    got = ngram_quality.judge(texts, labels, order=3, shard=shard).collect()
    assert len(got) == len(table)
    assert not any(r["kept"] for r in got if 100 <= r["key"] < 120)
    assert sum(r["kept"] for r in got if r["key"] < 60) >= 57
    assert all(r["kept"] and r["perplexity"] is None for r in got if r["key"] in (200, 201))
    assert len([r for r in got if r["key"] == 3]) == 2
    assert ngram_quality.judge(none, labels).count() == 0
    assert all(r["kept"] for r in ngram_quality.judge(docs, labels.limit(0)).collect())


def test_shards_agree(spark):
    rng = random.Random(10)
    texts = spark.createDataFrame([(i, words(rng, 60), "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    one, many = ({r["key"]: r["perplexity"] for r in ngram_quality.judge(texts, labels, shard=s).collect()} for s in (2_000_000, 30))
    assert one == pytest.approx(many)


def test_toxicity(spark, docs, none):
    rng = random.Random(11)
    table, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = words(rng, rng.randint(20, 90)).split()
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["vilestem", "vilestock", "foulest"]) + rng.choice(["", "a", "um", "is"])
        table.append((i, " ".join(text)))
        if i < 400:
            labels.append((i, 1, int(bad)))
    texts = spark.createDataFrame(table + [(900, None), (901, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.scored(texts, toxicity.learn(texts, known)).collect()}
    held_out = range(400, 600)
    assert sum(got[i] == (i % 4 == 0) for i in held_out) >= 195
    assert not got[900] and not got[901]
    assert toxicity.keep_clean(none, known.limit(0)).count() == 0
    kept = toxicity.keep_clean(docs, known.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_quality_classifier_knows_the_order_of_words(spark):
    """Trusted words in senseless order are rejected, though their bytes are those of good text."""
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdkl" for b in "aeiou" for c in "mnrst"]
    follows = {w: rng.sample(vocabulary, 3) for w in vocabulary}

    def say(n):
        out = [rng.choice(vocabulary)]
        while len(out) < n:
            out.append(rng.choice(follows[out[-1]]))
        return out

    good = [say(80) for _ in range(200)]
    mixed = [rng.sample(w, len(w)) for w in good[:20]]
    texts = spark.createDataFrame([(i, " ".join(w), "en") for i, w in enumerate(good + mixed)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int")
    kept = {r["key"]: r["kept"] for r in ngram_quality.judge(texts, labels).collect()}
    assert not any(kept[i] for i in range(200, 220))
    assert sum(kept[i] for i in range(150)) >= 148


def test_word_model_adds_up(spark):
    """Probabilities of all known words after a context, and what is left for unknown ones, add up to 1."""
    rng = random.Random(13)
    vocabulary = ["a", "b", "c", "d", "e"]
    good = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary) for _ in range(12))) for i in range(20)], "row long, text string").selectExpr("row", "true own", "text")
    names = dict(zip(vocabulary + ["u"], ngram_quality._codes([w.encode() for w in vocabulary] + [b"u"]).tolist(), strict=True))
    words = spark.createDataFrame([(w, math.log(1 / 6)) for w in names.values()], "w long, base double")
    known, rests = ngram_quality.word_model(ngram_quality.word_grams(good, 3), words, 3)
    contexts = [("a", "b"), ("u", "c"), ("u", "u")]
    asked = spark.createDataFrame([(1000 + 10 * i + j, names[x], names[y], z) for i, (x, y) in enumerate(contexts) for j, z in enumerate(names.values())], "row long, w0 long, w1 long, w2 long").selectExpr("row", "false own", "w0", "w1", "w2")
    got = {r["row"]: math.exp(r["s"]) for r in ngram_quality.log_probabilities(asked, known, rests, 3).collect()}
    for i in range(len(contexts)):
        assert sum(got[1000 + 10 * i + j] for j in range(6)) == pytest.approx(1)


def test_keep_first_goes_by_component(spark):
    """Rows that share a key, or have none, but aren't near copies stay; a copy goes, whatever else has its key."""
    rng = random.Random(14)
    say = lambda: " ".join(rng.choice(["ka", "lo", "mi", "nu", "pe", "ra", "si", "to"]) + str(rng.randrange(99)) for _ in range(60))
    a, b, c, d, e = (say() for _ in range(5))
    table = [(None, a), (None, b), (None, b), (1, c), (1, d), (None, c), (0, e), (2, e), (2, say()), (1, e), (3, None), (3, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_first(docs).collect()]
    assert collections.Counter(x for x in got if x[1]) == collections.Counter([(None, a), (None, b), (1, c), (1, d), (0, e), table[8]])
    assert len([x for x in got if not x[1]]) == 1


def test_quality_classifier_against_plain_kneser_ney(spark):
    """Perplexities of word trigrams by dictionaries, for new documents and, without the word itself, for trusted ones."""
    from pyspark.sql import functions as F

    rng = random.Random(14)
    vocabulary = [rng.choice("bdk") + rng.choice("aeiou") + rng.choice("mn") for _ in range(12)]
    say = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25)))
    trusted, new = [say() for _ in range(30)], [say() + rng.choice(["", " zzz", " q"]) for _ in range(15)]
    texts = spark.createDataFrame([(i, t, "en") for i, t in enumerate(trusted + new)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    got = {r["key"]: r["perplexity"] for r in ngram_quality.judge(texts, labels).collect()}

    spaced = texts.where("doc_id < 30").select(F.concat(F.lit("  "), F.regexp_replace("text", " ", "  "), F.lit("  ")).alias("text"))
    (spelling,) = ngram_quality.shards(ngram_quality.counted(spaced, "text"))

    def base(w):
        data = np.frombuffer(b"  " + w.encode() + b" ", np.uint8)
        return math.exp(spelling.log_probability(ngram_quality.grams(data, 3)).sum())

    grams = lambda t: list(zip(["", "", *t.split()], ["", *t.split()], t.split()))
    counts = [None, None, None, collections.Counter(g for t in trusted for g in grams(t))]
    counts[2] = collections.Counter(g[1:] for g in counts[3])
    counts[1] = collections.Counter(g[1:] for g in counts[2])
    off = [None] + [ngram_quality.discounts(collections.Counter(c.values())) for c in counts[1:]]
    D = lambda k, n: off[k][min(n, 3)]
    total, left = collections.Counter(), collections.Counter()
    for k in (1, 2, 3):
        for g, n in counts[k].items():
            total[k, g[:-1]] += n
            left[k, g[:-1]] += D(k, n)

    def p(g):
        k = len(g)
        if not k:
            raise AssertionError
        lower = p(g[1:]) if k > 1 else base(g[0])
        if not total[k, g[:-1]]:
            return lower
        n = counts[k][g]
        return (n - D(k, n) + left[k, g[:-1]] * lower) / total[k, g[:-1]]

    def own(g):
        k, n, t, o = len(g), counts[len(g)][g], total[len(g), g[:-1]], left[len(g), g[:-1]]
        fewer = o - D(k, n) + D(k, n - 1)
        if n > 1:
            return (n - 1 - D(k, n - 1) + fewer * (p(g[1:]) if k > 1 else base(g[0]))) / (t - 1)
        if k == 1:
            return fewer / (t - 1) * base(g[0])
        return (max(o - off[k][1], 1e-9) / (t - 1) if t > 1 else 1) * own(g[1:])

    for i, t in enumerate(trusted + new):
        logs = [math.log((own if i < 30 else p)(g)) for g in grams(t)]
        assert got[i] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-6), t


def test_chain_against_plain_regressions():
    """Weights, out-of-fold probabilities and thresholds as slow descents and plain loops give them."""
    rng = np.random.default_rng(15)
    x = (rng.random((120, 5)) < 0.4).astype(float)
    first = (x[:, 0] + 0.3 * rng.normal(size=120) > 0.5).astype(float)
    y = np.column_stack([first, ((x[:, 1] + first + 0.3 * rng.normal(size=120)) > 1.2).astype(float)])
    chain = toxicity.train(x, y, ["one", "two"], {})

    def plain(a, b):
        w, ridge = np.zeros(a.shape[1]), np.r_[np.full(a.shape[1] - 1, toxicity.PENALTY), 1e-6]
        for _ in range(60_000):
            w -= 0.02 * (a.T @ (1 / (1 + np.exp(-a @ w)) - b) + ridge * w)
        return w

    ones, earlier = np.ones((120, 1)), np.empty((120, 0))
    for j in range(2):
        a = np.hstack([x, earlier, ones])
        assert np.allclose(chain.weights[j], plain(a, y[:, j]), atol=0.02)
        out = np.empty(120)
        for f in range(toxicity.FOLDS):
            held = np.arange(120) % toxicity.FOLDS == f
            out[held] = 1 / (1 + np.exp(-a[held] @ plain(a[~held], y[~held, j])))
        gain = lambda t: (out[y[:, j] == 1] >= t).mean() - toxicity.FALSE_COST * (out[y[:, j] == 0] >= t).mean()  # noqa: E731, B023
        assert gain(chain.thresholds[j]) == pytest.approx(max(map(gain, out)), abs=1e-9)
        earlier = np.hstack([earlier, out[:, None]])
    p = chain.probabilities(x)
    assert np.allclose(p[:, 1], 1 / (1 + np.exp(-np.column_stack([x, p[:, 0], np.ones(120)]) @ chain.weights[1])))


def test_sharding_is_plain_lpt(spark, rows):
    """The loads of all shards as sorting groups by size and a heap give them."""
    import heapq

    rng = random.Random(16)
    table = [(i, "x" * rng.choice([1, 5, 5, 30, 200, 999])+ str(rng.randint(0, 40))) for i in range(700)]
    got = collections.Counter()
    for r in sharding.shard(spark.createDataFrame(table, "doc_id long, text string"), shards=7).collect():
        got[r["shard"]] += r["size"]
    groups = collections.Counter()
    for _, t in table:
        groups[t] += len(t) + 8
    heap = [(0, j) for j in range(7)]
    for size in sorted(groups.values(), reverse=True):
        load, j = heap[0]
        heapq.heapreplace(heap, (load + size, j))
    assert got == collections.Counter({j: load for load, j in heap})


def test_fillings_have_a_bound():
    """The number of fillings depends on the window, not on how many pieces there are."""
    rng = random.Random(17)
    for scale in (1, 1000, 10**9):
        histogram = {k: rng.randint(1, 50) * scale for k in range(1, 129)}
        assert len(packing.plan(histogram, 128)) <= sum(1 + 128 // k for k in range(1, 129))


def test_very_long_texts(spark):
    """Texts of over a megabyte, one of them a single word, through every operator over documents."""
    rng = random.Random(18)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(160_000))
    table = [(1, long), (2, "start " + long[500_000:]), (3, "y" * 1_200_000), (4, "short"), (5, None)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in table], "doc_id long, text string, lang string, source string").repartition(2)
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.judge(docs).collect()} == {k: len(tokens(t)) for k, t in table}
    assert {r["key"]: r["fp"] % 2**64 for r in simhash.fingerprints(docs.where("doc_id > 2")).collect()} == {k: plain_fingerprint(t) for k, t in table[2:]}
    got = {r["key"]: r for r in suffix_dedup.digests(docs).collect()}
    assert got[2]["n_removed"] == len(long) - 500_000 and got[2]["n_spans"] == 1 and got[1]["n_removed"] == 0
    assert got[3]["n_removed"] == 0
    assert toxicity.keep_clean(docs, labels).count() == 5
    assert ngram_quality.judge(docs, labels).count() == 5
    sizes = {r["key"]: r["size"] for r in sharding.shard(docs).collect()}
    assert sizes == {k: len(t or "") + 8 for k, t in table}
    back = {r["key"]: r["decoded_sha256"] for r in bpe.round_trip(docs, multi(), public_tokenizers.PATTERN).collect()}
    assert back == {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in table}
    packed = packing.pack(docs, gpt()).groupBy("key").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(packed) == 5 and all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)


def test_names_that_clash(spark):
    """Rows keep columns of any name where whole rows are kept, as they were."""
    rng = random.Random(19)
    names = ["toxic", "low_quality", "p_toxic", "_text", "_words", "n_words", "row", "v", "t", "w", "_key", "mine", "hash", "host", "base_failed"]
    table = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(70)), "s", *["z"] * len(names)) for i in range(6)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for kept in (toxicity.keep_clean(docs, labels), quality_rules.keep_good(docs), simhash.keep_first(docs), suffix_dedup.remove_repeats(docs)):
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == sorted(table)


def test_quality_classifier_in_slices(spark, monkeypatch):
    """Slices change no perplexity, bound what is on disk at a time, and leave one table of small rows."""
    import os

    from scholium.llm import common

    def folder():
        return [os.path.join(at, f) for at, _, files in os.walk(common._folder(spark)) for f in files if f.endswith(".parquet")]

    rng = random.Random(21)
    table = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(600)), "en") for i in range(120)]
    texts = spark.createDataFrame([*table, (900, "a", "en"), (901, None, "en"), table[3]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    sizes, write = [], ngram_quality.cut

    def weighed(df):
        out = write(df)
        sizes.append(sum(map(os.path.getsize, set(folder()) - before)))
        return out

    monkeypatch.setattr(ngram_quality, "cut", weighed)
    got, most = [], []
    for slices in (1, 5):
        before, sizes[:] = set(folder()), []
        judged = ngram_quality.judge(texts, labels, slices=slices)
        got.append({r["key"]: r["perplexity"] for r in judged.collect()})
        most.append(max(sizes))
        assert sum(map(os.path.getsize, set(folder()) - before)) < 0.2 * most[0]
    assert got[0].keys() == got[1].keys() and got[0][900] is None
    assert [got[0][k] for k in range(120)] == pytest.approx([got[1][k] for k in range(120)])
    assert most[1] < 0.6 * most[0]


def test_codes_of_words():
    """Words are those of bytes.split(), and different words of all lengths have different codes, in any company."""
    for text in (b"", b" \n", b"a", b" a  b\tc\x0b\x1cd\xc2\xa0e\r"):
        data = np.frombuffer(text, np.uint8)
        assert [text[i:j] for i, j in zip(*ngram_quality._places(data), strict=True)] == text.split()
    rng = random.Random(22)
    some = sorted({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 80))) for _ in range(20_000)})
    codes = ngram_quality._codes(some).tolist()
    assert len(set(codes)) == len(some) and 0 not in codes
    assert [c for w in some[:50] for c in ngram_quality._codes([w]).tolist()] == codes[:50]
