"""WARC archives, the prefix trie and importance resampling against plain versions, and the cases of their docstrings."""

import gzip
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import importance, prefix_trie, warc

PAGES = "page_id long, url string, html string"
TURNS = "conv_id long, turn long, role string, text string"


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def pages(spark):
    big, shared = "x" * 300_000 + "é", "<p>" + "same page " * 20
    rows = [(i, f"http://h/{i}", f"<html>{i} " + "w " * (i % 90)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://h/a b\r\nX: y", "short"), (103, "http://h/c", "short"), (104, "u", big), (90, "u", big), (None, "n", shared), (None, "n", "<p>" + "no id " * 40), (None, "n", "<p>" + "no id " * 40)]
    rows += [(200 + i, "http://hot/", shared) for i in range(80)] + [(200, "http://again/", shared)]
    return rows


def plain_types(rows):
    first = defaultdict(list)
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html].append(page)
    out = []
    for page, _, html in rows:
        least = min(first[html]) if first.get(html) else None
        again = least is not None and page != least
        out.append((page, len((html or "").encode()), digest(html), "revisit" if again else "response", least if again else None))
    return Counter(out)


@pytest.mark.parametrize("file_bytes", [1 << 30, 2000])
def test_archive_and_its_index(spark, pages, tmp_path, file_bytes):
    path = f"file://{tmp_path}/warc"
    index = warc.write_archive(spark.createDataFrame(pages, PAGES).withColumn("first", F.lit("clash")).repartition(3), path, file_bytes=file_bytes)
    got = warc.read_archive(index, path)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == plain_types(pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.collect()) == plain_types(pages)
    bodies = {r.page_id: r.payload for r in got.where("record_type = 'response' and page_id is not null").collect()}
    assert bodies[104 if 104 in bodies else 90].decode() == "x" * 300_000 + "é" and bodies[100] == b""
    assert {r.url for r in got.where("page_id = 102").collect()} == {"http://h/a%20b%0D%0AX:%20y"} and {r.url for r in index.where("page_id = 102").collect()} == {"http://h/a b\r\nX: y"}
    assert {(r.page_id, r.url) for r in got.where("page_id in (100, 101)").collect()} == {(100, None), (101, "")}
    some = warc.read_archive(index.where("url like 'http://h/1%'"), path)
    assert {r.page_id for r in some.collect()} == {1, *range(10, 20)}
    # The files are runs of gzip members that any reader takes apart.
    files = [r.file for r in index.select("file").distinct().collect()]
    assert (len(files) > 3) == (file_bytes < 10_000)
    kinds = Counter()
    for file in files:
        with gzip.open(file) as f:
            for part in f.read().split(b"\r\n\r\nWARC/1.1\r\n"):
                kinds[part.split(b"WARC-Type: ")[1].split(b"\r\n")[0]] += 1
    assert kinds[b"response"] + kinds[b"revisit"] == len(pages) and kinds[b"warcinfo"] == len(files)


def test_archive_of_nothing_and_damage(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert warc.read_archive(warc.write_archive(spark.createDataFrame([], PAGES), path), path).count() == 0
    member = warc.page_record(7, "http://h/", b"some payload", hashlib.sha256(b"some payload").hexdigest(), None, False)
    assert warc.parsed(member)[:3] == (7, "http://h/", "response") and warc.parsed(member)[6] == b"some payload"
    wrong = warc.page_record(7, "http://h/", b"some payload", "0" * 64, None, False)
    for bad in (member[:-3], member + b"x", member[:30] + b"?" + member[31:], wrong, b""):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_ranges_are_coalesced():
    ranges = [(0, 10), (10, 10), (25, 5), (100, 50), (150, 50), (200, 500)]
    assert list(warc.coalesced(ranges, gap=5, run=100)) == [(0, 3), (3, 5), (5, 6)]
    assert list(warc.coalesced(ranges, gap=1000, run=10_000)) == [(0, 6)] and list(warc.coalesced([], 1, 1)) == []


def plain_trie(sequences):
    """The contract's nodes of {conv_id: turns}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, own in members.items():
        worth = (len(own) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += worth
    rows = []
    for k, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(sequences[c]) == len(k))))
        rows.append((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), children[k], leaves[k], saved[k], digest(ends)))
    return Counter(rows)


def plain_turns(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for *_, r, t in sorted(x)] for c, x in own.items()}


def plain_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return out


@pytest.fixture(scope="module")
def conversations():
    rng = np.random.default_rng(5)
    rows = []
    for c in range(-12, 150):
        if c % 11 == 3:
            continue
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, str(rng.choice(["user", "assistant"])), str(rng.choice(["yes", "no", "é", ""]))))
    rows += [(500, i, "user", f"long {i % 3}") for i in range(150)] + [(505, i, "user", f"long {i % 3}") for i in range(140)]
    rows += [(600, None, None, None), (600, 1, "user", "b"), (600, 1, "user", "a"), (600, 1, "user", "a"), (600, None, "user", "z"), (None, 1, "user", "lost"), (601, 0, "user", "x" * 100_000)]
    rows += [(1000 + 5 * i, t, "user", f"copy {t}") for i in range(60) for t in range(3)]
    return [rows[i] for i in rng.permutation(len(rows))]


def trie_rows(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("ties", [True, False])
def test_trie_against_a_plain_version(spark, conversations, ties):
    rows = conversations if ties else [r for r in conversations if r[0] != 600]
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("clash"), "f1": F.lit(1)}).repartition(7)
    own = plain_turns(rows)
    assert trie_rows(prefix_trie.trie(prefix_trie.rebuilt_paths(df))) == plain_trie(plain_rebuilt(own))
    if ties:
        assert trie_rows(prefix_trie.trie(prefix_trie.plain_paths(df))) == plain_trie(own)


@pytest.mark.parametrize("bits", [2, 5])
def test_trie_splits_collisions(spark, conversations, bits):
    rows = [r for r in conversations if r[0] is not None and (-5 <= r[0] < 60 or r[0] == 600)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert trie_rows(prefix_trie.trie(prefix_trie.rebuilt_paths(df, bits))) == plain_trie(plain_rebuilt(plain_turns(rows)))


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt_paths(spark.createDataFrame([], TURNS))).count() == 0
    assert prefix_trie.trie(prefix_trie.rebuilt_paths(spark.createDataFrame([(None, 1, "user", "a")], TURNS))).count() == 0


def test_scan_carries_between_ranges(monkeypatch, spark, conversations):
    """The longest conversation alone fills several ranges."""
    monkeypatch.setattr(prefix_trie, "_tasks", lambda df: 12)
    rows = [r for r in conversations if r[0] in (500, 505)]
    assert trie_rows(prefix_trie.trie(prefix_trie.plain_paths(spark.createDataFrame(rows, TURNS)))) == plain_trie(plain_turns(rows))


def words_of(text):
    out, now = [], bytearray()
    for b in (text or "").encode() + b" ":
        b += 32 if 65 <= b <= 90 else 0
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            now.append(b)
        elif now:
            out.append(bytes(now))
            now = bytearray()
    return out


def plain_draw(rows, target, buckets, ngrams, percent, least, seed):
    grams = lambda w: [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]
    own = [(d, words_of(t)) for d, t in rows]
    s, t = Counter(b for _, w in own for b in grams(w)), Counter(b for x in target for b in grams(words_of(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    scored = []
    for d, w in own:
        g = grams(w)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        scored.append((d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    able = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1]))
    drawn = len(able) * percent // 100
    return Counter([(*x[:4], k + 1 if k < drawn else None) for k, x in enumerate(able)] + [(*x[:4], None) for x in scored if not x[4]])


@pytest.mark.parametrize(("buckets", "ngrams", "percent", "least"), [(10_000, 1, 10, 20), (97, 3, 35, 2), (1 << 16, 2, 100, 0)])
def test_draw_against_a_plain_version(spark, buckets, ngrams, percent, least):
    rng = np.random.default_rng(12)
    vocabulary = ["word", "Word2", "über", "日本語", "x" * 50, "it's", "a-b", "1.5", "\x00z"]
    rows = [(1, None), (2, ""), (3, " .,!"), (None, "no id " * 30), (5, "same " * 25), (5, "same " * 25), (6, "y" * 5000 + " end")]
    rows += [(10 + i, " ".join(vocabulary[int(k)] for k in rng.integers(0, len(vocabulary), int(rng.integers(0, 60))))) for i in range(120)]
    target = ["word it's", None, "日本語 1.5"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("clash"), "score": F.lit(1)}).repartition(6)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), buckets, ngrams, percent, least, 7)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_draw(rows, target, buckets, ngrams, percent, least, 7)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none.select("text")).count() == 0
    alone = importance.resample(docs, none.select("text"), buckets, ngrams, percent, least, 7)
    assert Counter(tuple(r) for r in alone.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_draw(rows, [], buckets, ngrams, percent, least, 7)


def test_drawn_documents_and_limits(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 15, "en") for i in range(50)], "doc_id long, text string, lang string")
    target = spark.createDataFrame([("text",)], "text string")
    ids = {r.doc_id for r in importance.resample(docs, target, percent=20).where("rank is not null").collect()}
    assert len(ids) == 10 and {(r.doc_id, r.lang) for r in importance.drawn_documents(docs, target, percent=20).collect()} == {(i, "en") for i in ids}
    for bad in ({"buckets": 0}, {"buckets": 1 << 17}, {"ngrams": 0}):
        with pytest.raises(ValueError):
            importance.resample(docs, target, **bad)


def test_crc_against_zlib():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4900, 300)
    end = np.minimum(5000, start + rng.integers(0, 90, 300))
    before = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    assert importance.crc32_on(before, data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(start, end, before, strict=True)]
