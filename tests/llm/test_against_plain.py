"""Operators against plain versions written without Spark, and the cases of their docstrings."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import common, decontaminate, importance, jaccard, language, language_model, licenses, media, packing, records, substring, toxicity
from sightline.llm.tokens import vocabulary_path

ROWS = "doc_id long, text string"
FULL = "doc_id long, text string, lang string, source string, n_chars long"


def split(text, lower=False):
    raw = (text or "").encode()
    raw = raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) if lower else raw
    return [w for w in raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]


@pytest.fixture(scope="module")
def mixed(spark):
    """Texts of all kinds: null, empty, blanks, one very long token, a long text, repeats, other scripts, two rows of one id."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{x}" for x in range(200)] + ["über", "日本語", "Straße", "don't", "x" * 40, "3.14", "é", " a"]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "z" * 70_000), (5, "same text here again"), (6, "same text here again"), (6, "other text of one id"), (None, "no id at all"), (None, None), (9, "tail  two   blanks\n\nend ")]
    rows += [(20 + i, " ".join(vocabulary[int(k)] for k in rng.integers(0, len(vocabulary), int(rng.integers(1, 400))))) for i in range(60)]
    rows.append((90, " ".join(vocabulary[int(k)] for k in rng.integers(0, len(vocabulary), 9000))))
    return spark.createDataFrame(rows, ROWS).repartition(5), rows


def ids_of(text, end):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "tokenizer"):
        ids_of.tokenizer = Tokenizer.from_file(vocabulary_path())
    return [*ids_of.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_against_the_tokenizer(mixed):
    df, rows = mixed
    got = packing.pack_documents(df).collect()
    expected = Counter()
    for doc, text in rows:
        ids = ids_of(text, packing.END_ID)
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        expected.update((doc, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    total, sequences = sum(r.length for r in got), {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-total // 1024) + 2


def test_packing_never_puts_all_items_into_one_group(spark, monkeypatch):
    seen = []
    plain = packing.best_fit
    monkeypatch.setattr(packing, "GROUP_ITEMS", 50)
    rng = np.random.default_rng(2)
    for low, high in ((513, 1023), (1, 1024), (300, 340)):
        sizes = rng.integers(low, high, 2000)
        items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "item long, size long")
        out = {r.item: (r.bin, r.offset) for r in packing.pack_items(items, group_items=50).collect()}
        bins = {}
        for i, s in enumerate(sizes.tolist()):
            bins.setdefault(out[i][0], []).append((out[i][1], s))
        for own in bins.values():
            at = 0
            for offset, s in sorted(own):
                assert offset == at
                at += s
            assert at <= 1024
        seen.append(len(bins))
        assert len(bins) <= 1.1 * len(plain(sizes, 1024)[2]) + 8
    assert seen[0] == 2000


def test_records_against_the_tokenizer(mixed, tmp_path):
    df, rows = mixed
    path = f"file://{tmp_path}/records"
    got = records.read_digests(records.write_records(df, path, partitions=4), path).collect()
    low = -(1 << 63)
    ordered = sorted(rows, key=lambda r: (low if r[0] is None else r[0], (r[1] or "").encode()))
    start, expected = 0, []
    for doc, text in ordered:
        ids = ids_of(text, records.END_ID)
        expected.append((low if doc is None else doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(expected)


def test_language_model_against_plain_counts(mixed):
    df, rows = mixed
    held = (F.coalesce(F.col("doc_id"), F.lit(0)) % 5) == 0
    flagged = df.withColumn("held_out", held)
    plain = {}
    for doc, text in rows:
        plain.setdefault((doc or 0) % 5 == 0, []).append((doc, split(text, True) + [None]))
    counts = Counter(w for _, words in plain[False] for w in words)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((doc or -1), len(words), sum(counts[w] > 0 for w in words), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6)) for part in plain.values() for doc, words in part)
    found = []
    for fan, table in ((4096, 1 << 17), (2, 20)):
        model, classed = language_model.fit(flagged.where(~held), 9, fan=fan, table=table, members=64)
        got = language_model.score(flagged, model, classed, 9, fan).collect()
        assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
        found.append(sum(r.score for r in got))
        if table > 1000:  # the classes' probabilities of one word after another sum to one
            counts_of = model.n + model.v
            counts_of[model.shapes : model.shapes + language_model.SHAPES] += 1
            own = 10**model.price - (1 - language_model.MIX) / (n + v + 1)
            share = (own * counts_of[None, :]).sum(1) / language_model.MIX
            assert np.all(share <= 1 + 1e-9) and np.isfinite(model.price).all()
    assert found[0] == pytest.approx(found[1], rel=0.2)


def test_factors_are_longest_earlier_matches():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = int(rng.integers(1, 50))
        keys, owner = rng.integers(0, int(rng.integers(1, 9)), n).astype(np.uint64), np.sort(rng.integers(0, int(rng.integers(1, 6)), n))

        def match(i, j):
            k = 0
            while max(i, j) + k < n and owner[i + k] == owner[i] and owner[j + k] == owner[j] and keys[i + k] == keys[j + k]:
                k += 1
            return k

        at, plain = 0, []
        while at < n:
            best = max((match(at, j) for j in range(at)), default=0)
            if best:
                plain.append((at, best))
            at += max(1, best)
        place, length, source = substring.greedy_factors(keys, owner)
        assert list(zip(place.tolist(), length.tolist(), strict=True)) == plain
        assert all(s < p and match(p, s) == m for p, m, s in zip(place.tolist(), length.tolist(), source.tolist(), strict=True))


@pytest.mark.parametrize("settings", [{}, {"blocks": 50, "fan": 3}, {"hot_segments": 0}])
def test_substrings_with_a_hot_phrase_among_varying_neighbours(spark, settings):
    rng = np.random.default_rng(6)
    phrase = [f"p{x}" for x in range(12)]
    rows = [(i, " ".join([f"a{x}" for x in rng.integers(0, 4, 6)] + phrase + [f"b{x}" for x in rng.integers(0, 3, 5)] + [f"t{x}" for x in rng.integers(0, 5000, 20)])) for i in range(150)]
    seen, expected = set(), {}
    for i, text in rows:
        own = text.split()
        gone = np.zeros(len(own), bool)
        for k in range(len(own) - 19):
            if tuple(own[k : k + 20]) in seen:
                gone[k : k + 20] = True
            seen.add(tuple(own[k : k + 20]))
        expected[i] = int(gone.sum())
    assert sum(expected.values())
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    assert {r.doc_id: r.n_removed for r in substring.remove_duplicates(df, **{k: v for k, v in settings.items() if k == "blocks"}).collect()} == expected
    spans = {}
    for r in substring.duplicate_spans(df, **settings).collect():
        gone = substring.covered(r.spans, 43)
        spans[r["__id"]] = int(gone.sum())
    assert spans == {i: n for i, n in expected.items() if n}
    found = substring.factors(df, **settings).where("source_id is not null").collect()
    texts = dict(rows)
    for r in found:  # each factor stands at its source
        assert texts[r.doc_id].split()[r.first_word : r.first_word + r.n_words] == texts[r.source_id].split()[r.source_word : r.source_word + r.n_words]
        assert (r.source_id, r.source_word) < (r.doc_id, r.first_word)


def test_a_run_costs_the_same_whatever_the_number_of_blocks():
    rng = np.random.default_rng(1)
    text = " ".join(f"w{x}" for x in rng.integers(0, 50_000, 150_000)).encode()
    words = common.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    took = {}
    for blocks in (16, 4096, 100_000, 10_000_000):
        pending = substring.Pending(blocks, common.deal_widths(blocks)[0], 20, 6, np.zeros(0, np.uint64))
        pending.add(np.array([1]), np.array([1], np.uint32), words, len(text))
        began = time.perf_counter()
        rows = sum(b.num_rows for b in pending.send())
        took[blocks] = time.perf_counter() - began
        assert rows <= common.FAN
    assert took[10_000_000] < 3 * took[4096] + 0.2 and took[100_000] < 3 * took[4096] + 0.2
    assert common.deal_widths(10) == [1] and common.deal_widths(5000) == [4096, 1] and len(common.deal_widths(1 << 30)) == 3


def test_jaccard_with_long_lists_and_several_dealings(spark):
    rng = np.random.default_rng(3)
    common_words = [f"c{x}" for x in range(40)]
    rows = [(i, " ".join(common_words + [f"w{x}" for x in rng.integers(0, 90, int(rng.integers(2, 14)))])) for i in range(70)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = [x if z == y else z for z in label]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    assert 1 < len(set(label)) < 70
    for settings in ({"long": 2}, {"long": 3, "blocks": 9, "fan": 2}):
        assert {r.doc_id: r.component_id for r in jaccard.link_classes(df, **settings).collect()} == dict(enumerate(label))


def test_decontamination_against_full_alignment(spark):
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60, n))) for i, n in enumerate([1, 2, 3, 4, 5, 8, 15, 30])]
    docs, rates = [], {}
    for i in range(400):
        words = items[int(rng.integers(0, len(items)))][1].split()
        rate, out = float(rng.choice([0, 0.1, 0.2, 0.3, 0.5])), []
        for w in words:
            r = rng.uniform()
            if r < rate / 3:
                continue
            out.append(f"w{int(rng.integers(0, 60))}" if r < 2 * rate / 3 else w)
            if 2 * rate / 3 <= r < rate:
                out.append(f"z{int(rng.integers(0, 60))}")
        around = [[f"w{x}" for x in rng.integers(0, 60, int(rng.integers(0, 25)))] for _ in range(2)]
        docs.append((i, " ".join(around[0] + out + around[1])))
        rates[i] = rate
    docs.append((900, " ".join(w + " ins" for w in items[7][1].split())))  # no two words stay side by side
    docs.append((901, "x " + items[1][1].upper() + ", y"))

    def hashes(text):
        return decontaminate.plain_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])).hash

    expected = {}
    for d, text in docs:
        for i, item in items:
            own = hashes(item)
            score = decontaminate.alignment(own, hashes(text))[0] / (2 * len(own))
            if score >= (1.0 if len(own) < 3 else 0.5):
                expected[d, i] = round(score, 6)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(spark.createDataFrame(docs, ROWS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == expected and (900, 7) in got and (901, 1) in got


def test_licenses_against_whole_documents(spark):
    rng = np.random.default_rng(9)
    rows, names = [], list(licenses.TEMPLATES)
    for i in range(120):
        words = licenses.TEMPLATES[names[int(rng.integers(0, len(names)))]].split()
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, len(words)))] = "changed"
        rows.append((i, " ".join([f"w{x}" for x in rng.integers(0, 90, int(rng.integers(0, 60)))] + words + ["end"])))

    def shingles(text):
        raw = text.encode()
        words = decontaminate.plain_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        own = [words.word(k) for k in range(len(words))]
        return {tuple(own[k : k + 5]) for k in range(len(own) - 4)}

    wanted = {n: shingles(t) for n, t in licenses.TEMPLATES.items()}
    sure, least = set(), set()
    for i, text in rows:
        have = shingles(text)
        for n, own in wanted.items():
            if own and len(own & have) >= 0.8 * len(own):
                sure.add((i, n))
    for partitions in (1, 7):
        got = {(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, ROWS).repartition(partitions)).collect()}
        assert got <= sure and len(got) >= 0.99 * len(sure)
        least.add(frozenset(got))
    assert sure


def test_media_against_plain_payloads(mixed):
    df, rows = mixed
    got = Counter()
    for r in media.media_digests(media.sniff_media(media.store_text_media(df))).collect():
        got[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature.split(";")[0]] += 1
    expected, kinds = Counter(), ("audio/wav", "image/bmp", "image/png")
    for doc, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        expected[doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), kinds[zlib.crc32(payload) % 3]] += 1
    assert got == expected and len({k[-1] for k in got}) == 3


def test_sniffer_finds_ends_of_flac_and_pdf():
    def frame(number, body):
        head = bytes([0xFF, 0xF8, 0x69, 0x08, number, len(body) - 1])
        c = 0
        for x in head:
            c = media._CRC8[c ^ x]
        out, c = head + bytes([c]) + b"\x02" + body, 0
        for x in out:
            c = (c << 8 & 0xFFFF) ^ media._CRC16[c >> 8 ^ x]
        return out + c.to_bytes(2, "big")

    flac = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(34) + frame(0, b"abcdefgh") + frame(1, b"ijklmnop")
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nxref\n0 1\ntrailer\n<<>>\nstartxref\n29\n%%EOF"
    found = media.Sniffer().scan(b"junk" + flac + b"more junk" + pdf + b" and %%EOF")
    assert found == [("audio/flac", 4, len(flac)), ("application/pdf", 4 + len(flac) + 9, len(pdf))]
    damaged = bytearray(flac)
    damaged[-3] ^= 1
    assert media.Sniffer().scan(bytes(damaged)) != [("audio/flac", 0, len(flac))]


def test_language_against_a_plain_parser():
    texts = {"aa": "aba abab abba baba " * 5, "cc": "cdc dcdc cddc abc " * 5, "日": "日本 本日 日日本 " * 5}
    parser = language.CrossParser(texts)
    probes = ["abba baba", "cddc ab", "日本日", "xyz", "aba cdc 日", "a" * 700, "ab1 2ba", ""]

    def plain(text, train):
        known = sorted(set("".join(texts.values()).replace(" ", "")))
        clean = lambda s: [c if c in known else "?" if c.isalpha() else " " for c in s.lower()]
        squeeze = lambda s: "".join(c for i, c in enumerate(s) if c != " " or i == 0 or s[i - 1] != " ")
        train, text = squeeze(clean(train)), squeeze(clean(text))
        own = set(train)
        count = 0
        for a in range(0, len(text), language.PIECE):
            piece, i, phrase = text[a : a + language.PIECE], 0, ""
            count += bool(piece)
            while i < len(piece):
                if phrase + piece[i] in train:
                    phrase += piece[i]
                else:
                    count += 1
                    phrase = piece[i] if piece[i] in own else ""
                i += 1
        return count

    got, letters = parser.phrases(probes)
    assert got.tolist() == [[plain(p, texts[n]) for n in parser.names] for p in probes]
    assert letters[-1] == 0


def test_toxicity_against_a_plain_scorer(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join((["vile"] if i % 3 == 0 else []) + [f"t{x}" for x in rng.integers(0, 300, 12)])) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    probes = [(1, "so v1le t1 t2"), (2, "vile vile"), (3, "t1 t5"), (4, None), (5, "v i l e day"), (6, "x" * 50_000)]
    for r in toxicity.score_toxicity(spark.createDataFrame(probes, ROWS), model).collect():
        raw = (dict(probes)[r.doc_id] or "").encode()
        doc, feature = toxicity.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model.restorer)
        shares = dict(zip(model.keys.tolist(), model.shares.tolist(), strict=True))
        rest = 1 - min(model.base, 0.999999)
        for f in set(feature.tolist()):
            rest *= 1 - shares.get(f, 0.0)
        assert r.toxic_score == pytest.approx(1 - rest, abs=1e-9) and r.toxic_predicted == int(r.toxic_score >= 0.3)
    assert toxicity.beyond_chance(np.array([20.0, 3.0]), np.array([0.0, 3.0]), 0.1, 1000).tolist() == [True, False]


CLASH = FULL + ", n_words string, kept_text string, media string, media_type string, carved string, toxic_score string, lang_pred string, lang_score string, piece string, item string, row string, id string, t1 string, shared string, held_out_x string"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, None), (2, ""), (4, "y" * 30_000), (5, "good words of a text " * 6), (5, "good words of a text " * 6), (None, "a b c d e f g"), (7, "an idiot text")]
    extra = ["x"] * 15
    return spark.createDataFrame([(i, t, "en" if t else None, "s", len(t or ""), *extra) for i, t in rows], CLASH)


def test_clashing_names_and_empty_tables(spark, clashing, tmp_path):
    none = clashing.limit(0)
    parser = language.fit(clashing)
    labels = spark.createDataFrame([(7, 1), (5, 0)], "doc_id long, toxic int")
    toxic = toxicity.fit(clashing.select("doc_id", "text"), labels)
    bench = spark.createDataFrame([(1, "good words of a text")], "item_id long, text string")
    held = lambda df: df.withColumn("held_out", F.lit(False))
    model, classed = language_model.fit(clashing, 4)

    def recorded(df):
        path = f"file://{tmp_path}/r{time.perf_counter_ns()}"
        return records.read_digests(records.write_records(df, path), path)

    operators = [
        (lambda df: decontaminate.contaminated(df, bench), 2),
        (lambda df: language_model.score(held(df), model, classed, 4), 7),
        (packing.pack_documents, 21),
        (substring.remove_duplicates, 7),
        (lambda df: media.media_digests(media.sniff_media(media.store_text_media(df))), 7),
        (jaccard.link_classes, 7),
        (lambda df: toxicity.score_toxicity(df, toxic), 7),
        (lambda df: language.identify(df, parser), 7),
        (recorded, 7),
        (licenses.scan_licenses, 0),
        (lambda df: importance.resample(df, bench), 7),
    ]
    for operator, n in operators:
        assert operator(clashing).count() == n
        assert operator(none).count() == 0
    assert media.sniff_media(media.store_text_media(clashing).withColumn("carved", F.lit(1))).schema["carved"].dataType.typeName() == "array"
    docs = clashing.select(*[c.split(" ")[0] for c in FULL.split(", ")])
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = [-1, 1, 2, 4, 5, 5, 7]
    kept = {"language_id": [-1, 4, 5, 5, 7], "near_duplicates": whole, "substring_dedup": whole, "benchmark_decontamination": [-1, 1, 2, 4, 7], "best_fit_packing": sorted([*whole, *[4] * 14])}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in stage(spark, clashing, str(tmp_path)).select("doc_id").collect()) == kept[name]


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(8)
    base = [[f"w{x}" for x in rng.integers(0, 500, 60)] for _ in range(6)]
    shared = [f"s{x}" for x in range(40)]
    item = [f"q{x}" for x in range(25)]
    texts = [" ".join(b) for b in base] + [" ".join([*base[0][:30], "new", *base[0][31:]]), " ".join(base[1]), "12 34", None, " ".join([f"u{x}" for x in range(90)] + shared), " ".join([f"v{x}" for x in range(90)] + shared), " ".join(["start", *[f"k{x}" for x in range(50)], *item])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, FULL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    kept = []
    for i, t in docs:  # no chains of links in this fixture
        if not any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j, _ in kept):
            kept.append((i, t))
    seen, cut = set(), []
    for i, t in kept:
        own = t.split()
        gone = np.zeros(len(own), bool)
        for k in range(len(own) - 19):
            if tuple(own[k : k + 20]) in seen:
                gone[k : k + 20] = True
            seen.add(tuple(own[k : k + 20]))
        cut.append((i, " ".join(w for w, g in zip(own, gone, strict=True) if not g) if gone.any() else t))
    clean = [(i, t) for i, t in cut if " ".join(item) not in t]
    assert len(docs) > len(kept) > len(clean) and cut != kept
    expected = {(i, len(ids_of(t, 2)), crc(ids_of(t, 2))) for i, t in clean}
    assert {(r.doc_id, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == expected
