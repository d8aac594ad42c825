"""The text operators: odd inputs (nulls, empty and long texts, ties, repeats, empty tables, clashing columns) and brute force."""

import hashlib
import io
import itertools
from collections import Counter
import re
import wave
import zlib

import numpy as np
import pytest

from sightline.llm.common import Words
from sightline.llm.decontaminate import alignment, contaminated
from sightline.llm.jaccard import link_classes
from sightline.llm.language import CrossParser, fit, identify, suffix_automaton
from sightline.llm.language_model import exchange, fit as fit_lm, score as score_lm
from sightline.llm.licenses import TEMPLATES, scan_licenses
from sightline.llm.media import Sniffer, media_digests, sniff_media, store_text_media, wav_of, wav_samples
from sightline.llm.packing import best_fit, pack_documents
from sightline.llm.records import fetch, frame, read_digests, read_records, unframe, write_records
from sightline.llm.substring import remove_duplicates
from sightline.llm.toxicity import CLASSES, fit as fit_toxic, score_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, item string"
PASSAGE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, PASSAGE), (5, PASSAGE), (5, PASSAGE), (6, "x " + PASSAGE + " y"), (None, "one two three"), (8, "ééé 日本"), (9, "long " * 30_000), (10, "idiot thing")]
    return spark.createDataFrame([(i, t, "en" if t else None, "s", len(t or ""), "clash", "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    raw = (text or "").encode()
    raw = raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) if lower else raw
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


def test_words_are_those_of_the_pattern():
    texts = ["a b", "", " x", "y\n", "Ünï\x0bcode"]
    raw = [t.encode() for t in texts]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert [[w.word(i) for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))] == [words(t) for t in texts]


def test_substrings(spark, odd, empty):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in remove_duplicates(odd).collect()}
    assert {(4, 60, 0), (5, 60, 60), (6, 62, 60), (1, 0, 0), (9, 30_000, 29_999)} <= got
    assert remove_duplicates(empty).count() == 0
    repeated = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE)], "doc_id long, text string").repartition(2)
    assert {r.n_removed for r in remove_duplicates(repeated).collect()} == {0}  # one document, given twice


@pytest.mark.parametrize("partitions", [1, 7])
def test_substrings_against_brute_force(spark, partitions):
    rng = np.random.default_rng(5)
    hot = [f"h{x}" for x in range(45)]
    rows = []
    for i in range(60):
        own = [f"w{x}" for x in rng.integers(0, 300, int(rng.integers(0, 40)))]
        at = int(rng.integers(0, len(own) + 1))
        rows.append((i, " ".join(own[:at] + (hot[int(rng.integers(0, 9)) :] if i % 3 else []) + own[at:])))
    seen, expected = set(), {}
    for i, text in rows:
        own = text.split()
        gone = np.zeros(len(own), bool)
        for k in range(len(own) - 19):
            if tuple(own[k : k + 20]) in seen:
                gone[k : k + 20] = True
            seen.add(tuple(own[k : k + 20]))
        expected[i] = (len(own), int(gone.sum()), " ".join(w for w, g in zip(own, gone, strict=True) if not g))
    got = remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == expected


def test_jaccard(spark, odd, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in link_classes(odd).collect()}
    assert {(4, 56, 4), (5, 56, 4), (6, 58, 4), (1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, None)} <= got
    assert link_classes(empty).count() == 0


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 400, n)] for n in (6, 12, 40, 150)]
    rows = []
    for b in base:
        for _ in range(25):
            copy = list(b)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = f"v{int(rng.integers(0, 50))}"
            rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in link_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(len(rows))}


def test_jaccard_takes_rows_apart_that_share_an_id_or_have_none(spark):
    from corpus_pipeline import near_duplicates

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " tail"
    rows = [(None, a), (None, b), (None, b), (11, a), (12, near), (21, b), (22, b), (30, a), (30, c), (40, c), (None, "lone words"), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in link_classes(docs).collect()))
    assert got == sorted([(0, 11), (0, 21), (0, 21), (11, 11), (12, 11), (21, 21), (22, 21), (30, 11), (30, 30), (40, 30), (0, 0), (0, 0), (0, 0)])
    left = [(r.doc_id, r.text) for r in near_duplicates(spark, docs, "").collect()]
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(left, key=key) == sorted([(11, a), (21, b), (30, c), (None, "lone words"), (None, ""), (None, None)], key=key)
    nameless = docs.where("doc_id is null and text like 'b%'").union(docs.where("doc_id = 12").selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))
    assert sorted(r.text[0] for r in near_duplicates(spark, nameless, "").collect()) == ["a", "b"]


def test_alignment_against_a_plain_matrix():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert alignment(a.astype(np.uint64), b.astype(np.uint64))[0] == h.max()


def test_decontamination_finds_edited_copies(spark, odd, empty):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "short")], "item_id long, text string")
    edited = " ".join(w if i % 6 else "changed" for i, w in enumerate(PASSAGE.split()))
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(50, "before " + edited + " after")], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(4, 1), (5, 1), (6, 1), (50, 1)}
    assert contaminated(empty, bench).count() == 0 and contaminated(odd, bench.limit(0)).count() == 0


def test_decontamination_finds_edited_copies_whatever_repeats(spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    edited = " ".join(w if i % 5 else "changed" for i, w in enumerate(PASSAGE.split()))
    for exact, copies in ((4, 1), (0, 9)):
        docs = spark.createDataFrame([(i, PASSAGE if i < exact else edited) for i in range(exact + copies)], "doc_id long, text string")
        got = {r.doc_id: r.score for r in contaminated(docs, bench).collect()}
        assert sorted(got) == list(range(exact + copies)) and 0.5 <= got[exact] < 0.8


def test_automaton_and_language(spark, odd, empty):
    symbols = [1, 2, 1, 3, 1, 2]
    table = suffix_automaton(symbols, 4)

    def accepts(s):
        state = 0
        for x in s:
            state = table[state, x]
            if state < 0:
                return False
        return True

    inside = {tuple(symbols[i:j]) for i in range(6) for j in range(i + 1, 7)}
    assert all(accepts(s) for s in inside) and not accepts((3, 3)) and not accepts((2, 2))
    parser = CrossParser({"aa": "aba abab abba baba " * 20, "cc": "cdc dcdc cddc " * 20})
    assert parser.predict(["abba", "cddc", "12 !", None, ""])[0] == ["aa", "cc", "und", "und", "und"]
    assert identify(odd, fit(odd)).count() == odd.count()
    assert identify(empty, fit(empty)).count() == 0
    assert {r.lang_pred for r in identify(odd, fit(empty)).collect()} == {"und"}


def test_languages_of_large_and_of_several_alphabets():
    rng = np.random.default_rng(8)
    letters = {"ar": (0x627, 28), "el": (0x3B1, 17), "en": (97, 26), "hi": (0x905, 50), "ja": (0x3041, 80), "ko": (0xAC00, 700), "ru": (0x430, 32), "zh": (0x4E00, 900)}
    text, probe = {}, {}
    for name, (first, n) in letters.items():
        own = ["".join(chr(first + int(c)) for c in rng.integers(0, n, 3)) for _ in range(300)]
        text[name], probe[name] = (" ".join(own[int(i)] for i in rng.integers(0, 300, size)) for size in (3000, 12))
    # Two languages of one script, with the same letters in other words.
    text["z2"], probe["z2"] = text["zh"][::-1], probe["zh"][::-1]
    parser = CrossParser(text)
    assert parser.predict([*probe.values()])[0] == [*probe]
    few = CrossParser(text, alphabet=5)  # how many letters the table holds makes no difference
    assert all((a == b).all() for a, b in zip(parser.phrases([*probe.values()]), few.phrases([*probe.values()]), strict=True))


def test_exchange_finds_two_classes():
    n = np.zeros((8, 8), int)  # members 0-3 and 4-7 follow members of the same half
    n[:4, :4] = n[4:, 4:] = 50
    group = exchange(n, 8, classes=2)
    assert len(set(group[:4])) == len(set(group[4:])) == 1 and group[0] != group[4]


def test_language_model(spark, odd, empty):
    from pyspark.sql import functions as F

    docs = odd.select("doc_id", "text").withColumn("held_out", F.lit(False))
    model, counted = fit_lm(docs, 4)
    rows = score_lm(docs, model, counted, 4).collect()
    assert len(rows) == 11 and all(r.n_known == r.n_tokens and r.train_tokens == sum(x.n_tokens for x in rows) for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    model, counted = fit_lm(docs.limit(0), 4)
    assert {r.n_known for r in score_lm(docs, model, counted, 4).collect()} == {0}


def test_best_fit_and_packing(spark, odd, empty):
    sizes = np.array([6, 5, 5, 4, 3, 3, 2, 2])
    bins, offsets, fill = best_fit(sizes, 10)
    assert fill == [10, 10, 10] and all(sorted(zip(offsets[bins == b], sizes[bins == b], strict=True))[0][0] == 0 for b in range(3))
    rows = pack_documents(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack_documents(empty).count() == 0


def test_records(spark, odd, empty, tmp_path):
    doc, ids, end = unframe(frame(7, np.array([1, 2, 70_000])), 0)
    assert (doc, ids.tolist()) == (7, [1, 2, 70_000]) and end == len(frame(7, np.array([1, 2, 70_000])))
    broken = bytearray(frame(7, np.array([1, 2, 3])))
    broken[-6] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        unframe(bytes(broken), 0)
    path = f"file://{tmp_path}/records"
    manifest = write_records(odd, path)
    rows, digests = read_records(manifest, path).collect(), read_digests(manifest, path).collect()
    assert len(rows) == len(digests) == 11
    assert {(r.doc_id, r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows} == {(r.doc_id, r.start, r.ids_crc32) for r in digests}
    first = manifest.orderBy("part").first()
    assert fetch(first["file"], first["index"], 0)[0] == min(r.doc_id for r in rows)


def test_media(spark, odd, empty):
    payload = b"abc".ljust(64, b"\0")
    data = wav_of(payload)
    with wave.open(io.BytesIO(data)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(99)) == (1, 1, payload)
    assert wav_samples(data) == payload
    png = _gray_png(2, 1, bytes(3))
    found = Sniffer().scan(b"junk" + png + b"GIF89a" + data)
    assert [(k, n) for k, _, n in found] == [("image/png", len(png)), ("audio/wav", len(data))]
    rows = {r.doc_id: r for r in media_digests(sniff_media(store_text_media(odd))).collect()}
    assert rows[1].payload_bytes == 64 and rows[4].payload_sha256 == hashlib.sha256(PASSAGE.encode() + bytes(-len(PASSAGE) % 64)).hexdigest()
    assert sniff_media(store_text_media(empty)).count() == 0


def test_toxicity(spark, odd, empty):
    rows = [(i, ("idiot " if i % 4 == 0 else "") + f"thing{i} of the{i % 50} day") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = fit_toxic(docs, labels)
    probe = spark.createDataFrame([(1, "an 1d10t here"), (2, "i d i o t"), (3, "a fine day"), (4, None), (5, "idiooot")], "doc_id long, text string")
    assert {r.doc_id: r.toxic_predicted for r in score_toxicity(probe, model).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    assert score_toxicity(empty, model).count() == 0
    assert score_toxicity(odd, fit_toxic(docs, labels.limit(0))).count() == 11


def test_toxicity_restores_signs_at_the_ends():
    from sightline.llm.toxicity import Restorer, suspicious

    def restored(text, plain):
        seen = np.frombuffer(b" ".join([plain] * 50), np.uint8)
        kind = CLASSES[seen]
        counts = np.bincount((kind[:-2] * 64 + kind[1:-1]) * 64 + kind[2:], minlength=1 << 18)
        raw = np.frombuffer(text, np.uint8)
        return {Restorer(counts).restore(t) for _, t in suspicious(raw, Words(raw, np.array([0, len(raw)]), hashes=False))}

    for token, word in ((b"a$$", b"ass"), (b"shi7", b"shit"), (b"dumb4$$", b"dumbass"), (b"a$$!", b"ass"), (b"bana!", b"banai"), (b"(razy!", b"crazy"), (b"(1d10t!)", b"idiot"), (b"\"p00,", b"poo")):
        assert word in restored(b"say " + token + b" now", word), token
    assert restored(b"a plain line, no more.", b"plain") == set()


def test_licenses(spark, odd, empty):
    rows = [(i, f"some text {i} " + t.lower() + " and more words after it") for i, t in enumerate(TEMPLATES.values())]
    got = {(r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, n) for i, n in enumerate(TEMPLATES)} <= got
    assert scan_licenses(odd).count() == 0 and scan_licenses(empty).count() == 0


def test_seeds_match_a_plain_version():
    from sightline.llm.decontaminate import Items, needed_pairs, pair_hash

    rows = [(3, "a b c d e f a b c"), (1, None), (7, "one two"), (2, "a b c x y z w"), (9, "a b c"), (4, "One, two"), (5, "a b q r s t u v")]
    items = Items(rows, common=2)
    texts = ["a b c d e f a b c", "", "one two", "a b c x y z w", "a b c", "a b q r s t u v"]
    assert items.ids == [[3], [1], [7, 4], [2], [9], [5]] and items.size.tolist() == [len(t.split()) for t in texts]
    holders = Counter(p for t in texts for p in {tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)})
    keys, owner, place = items.seeds[2]
    plain = []
    for i, t in enumerate(texts):
        own = items.words(i)
        plain += [(int(pair_hash(own[k : k + 1], own[k + 1 : k + 2])[0]), i, k) for k in range(len(own) - 1) if holders[tuple(t.split()[k : k + 2])] <= 2]
    whole = [j for j in range(len(keys)) if not (items.size[owner[j]] == 3 and place[j] == 0)]
    assert sorted((int(keys[j]), int(owner[j]), int(place[j])) for j in whole) == sorted(plain)
    lost = [sum(holders[tuple(t.split()[k : k + 2])] > 2 for k in range(len(t.split()) - 1)) for t in texts]
    assert items.least.tolist() == [max(1, max(1, needed_pairs(len(t.split()))) - n) for t, n in zip(texts, lost, strict=True)]
    assert Items([(1, ""), (2, None)]).seeds == {} and Items([]).seeds == {}


def test_items_of_common_pairs_keep_a_seed():
    from sightline.llm.decontaminate import Items

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 6, int(n))) for n in rng.integers(1, 40, 500)]
    items = Items(list(enumerate(texts)), common=3)
    served = set(np.concatenate([owner for _, owner, _ in items.seeds.values()]).tolist())
    assert served == set(range(len(items.size))) and set(items.seeds) - {1, 2}


def test_seed_entries_and_passages_are_linear_in_the_text():
    """Zipf text of one megabyte against 500 to 20 000 items: entries a word stay below a bound that doesn't grow with the items."""
    from sightline.llm.common import pieces
    from sightline.llm.decontaminate import COMMON, Items, passages, plain_words, seed_hits

    rng = np.random.default_rng(4)
    share = 1 / np.arange(1, 20_001)
    draw = lambda n: rng.choice(20_000, n, p=share / share.sum())
    raw = " ".join(f"w{x}" for x in draw(180_000)).encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.append(np.arange(0, len(raw), 4000), len(raw))
    chunks = [plain_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets)]
    entries = []
    for n in (500, 20_000):
        items = Items([(i, " ".join(f"w{x}" for x in own)) for i, own in enumerate(draw(18 * n).reshape(n, 18))])
        assert all(np.bincount(np.unique(keys, return_inverse=True)[1]).max() <= 18 * COMMON for keys, _, _ in items.seeds.values())
        found = sum(len(seed_hits(w, items)[0]) for w in chunks)
        opened = sum(len(passages(w, items)[0]) for w in chunks)
        words = sum(len(w) for w in chunks)
        assert found <= 4 * words and opened <= words
        entries.append(found)
    assert entries[1] <= 5 * entries[0]  # forty times the items


def test_recall_by_edit_rate():
    """Copies of 18-word items of Zipf text with a share of words replaced, left out or followed by another one: of those that a full alignment
    reports, nearly all are found, also against 20 000 items and where thousands of equally edited copies are around."""
    from sightline.llm.decontaminate import Items, aligned, passages, plain_words

    rng = np.random.default_rng(6)
    share = 1 / np.arange(1, 20_001)
    draw = lambda n: rng.choice(20_000, n, p=share / share.sum())
    own = draw(18 * 20_000).reshape(-1, 18)
    items = Items([(i, " ".join(f"w{x}" for x in w)) for i, w in enumerate(own)])
    for rate in (0.0, 0.1, 0.2, 0.3, 0.4):
        texts, ids = [], rng.integers(0, len(own), 400)
        for i in ids.tolist():
            out = []
            for w in own[i].tolist():
                kind = rng.uniform() / rate if rate else 9
                if kind > 1 / 3:
                    out.append(w if kind > 2 / 3 else int(draw(1)[0]))
                if 2 / 3 < kind < 1:
                    out.append(int(draw(1)[0]))
            texts.append(" ".join(f"w{x}" for x in [*draw(20), *out, *draw(20)]))
        raw = [t.encode() for t in texts]
        words = plain_words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))
        who, low, high = passages(words, items)
        hit = aligned(words, items, who, low, high, np.full(len(who), 0.5))
        found = {(int(words.doc[a]), int(w)) for a, w in zip(low[hit], who[hit], strict=True)}
        sure = [(d, i) for d, i in enumerate(ids.tolist()) if alignment(items.words(_index(items, i)), words.hash[words.first[d] : words.first[d + 1]])[0] >= 18]
        kept = sum((d, _index(items, i)) in found for d, i in sure)
        assert kept >= 0.97 * len(sure) and (sure or rate > 0.3)


def _index(items, i):
    if not hasattr(items, "by_id"):
        items.by_id = {x: k for k, ids in enumerate(items.ids) for x in ids}
    return items.by_id[i]


def test_needed_pairs_is_a_lower_bound():
    """All alignments of an item of up to six words, as steps between matches: neighbours, one word between, or what costs more."""
    from sightline.llm.decontaminate import needed_pairs

    for n in range(1, 7):
        least = n
        for m in range(1, n + 1):
            for kinds in itertools.product(("next", "one", "skip", "more"), repeat=m - 1):
                lost = sum({"next": 0, "one": 1, "skip": 1, "more": 2}[k] for k in kinds)
                if kinds.count("skip") <= n - m and 2 * m - lost >= n:
                    least = min(least, sum(k in ("next", "one") for k in kinds))
        assert needed_pairs(n) == least


def test_short_templates_are_one_shingle(spark):
    texts = {"two": "MIT license", "one": "Unlicense", "four": "some, rights (were) reserved", "five": "a b c d e"}
    rows = [(1, "under the MIT license. Or the mit-license"), (2, "an unlicense"), (3, "Some rights were reserved here"), (4, "mit"), (5, "license mit"), (6, "a b c d e"), (7, "the MIT"), (8, "license alone"), (9, None)]
    got = {(r.doc_id, r.license, r.containment, r.first_word, r.windows) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), texts).collect()}
    assert {x for x in got if x[1] != "five"} == {(1, "two", 1.0, 2, 2), (2, "one", 1.0, 1, 1), (3, "four", 1.0, 0, 1)} and {x[0] for x in got if x[1] == "five"} == {6}
    assert scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), {}).count() == 0


def _gray_png(width, height, lines):
    import struct

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_validators_hold_sizes_against_width_and_height():
    from sightline.llm.media import bmp_of, png_of

    whole = _gray_png(4, 3, bytes(15))
    assert Sniffer().scan(whole) == [("image/png", 0, len(whole))]
    for bad in (_gray_png(4, 3, bytes(14)), _gray_png(4, 3, bytes(16)), _gray_png(5, 3, bytes(15)), _gray_png(0, 3, b""), whole[:40] + b"?" + whole[41:]):
        assert Sniffer().scan(bad) == []
    big = png_of(b"ab" * (3 << 20))
    assert Sniffer().scan(big)[0] == ("image/png", 0, len(big))
    bmp = bmp_of(bytes(range(64)) * 5)
    assert Sniffer().scan(bmp)[0] == ("image/bmp", 0, len(bmp))
    wide, flat_ = bytearray(bmp), bytearray(bmp)
    wide[18:22] = (65).to_bytes(4, "little")
    flat_[18:22] = bytes(4)
    assert Sniffer().scan(bytes(wide)) == [] and Sniffer().scan(bytes(flat_)) == []


def test_embedded_files_are_carved_from_every_kind_of_store(spark):
    """A PDF inside of texts, at the same place whichever format holds the text; declared types are corrected where they are wrong."""
    pdf = "%PDF-1.4\n1 0 obj\n<< >>\nendobj\nxref\n0 1\ntrailer\n<< >>\nstartxref\n28\n%%EOF"
    at = pdf.index("xref\n0")
    pdf = pdf.replace("startxref\n28", f"startxref\n{at}")
    rows = [(i, f"text {i} before " + pdf + " after") for i in range(40)] + [(100, "no file here"), (101, "%PDF-1.4 broken %%EOF"), (102, None)]
    sniffed = sniff_media(store_text_media(spark.createDataFrame(rows, "doc_id long, text string")))
    kinds = {r.doc_id: (r.media_type, r.declared_type, r.mismatch) for r in sniffed.collect()}
    got = {r.doc_id: r.feature for r in media_digests(sniffed).collect()}
    assert {k for k, _, _ in kinds.values()} == {"audio/wav", "image/bmp", "image/png"}
    assert all(wrong == (k != said) for k, said, wrong in kinds.values()) and {w for *_, w in kinds.values()} == {True, False}
    for i, text in rows:
        carved = got[i].split("carved=")[1]
        assert carved == (f"application/pdf@{text.index('%PDF')}+{len(pdf)}" if i < 100 else "")
        assert f"corrected={str(kinds[i][2]).lower()}" in got[i] and got[i].startswith(kinds[i][0])
