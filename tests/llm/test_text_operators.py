"""Against plain Python, on a corpus of awkward texts."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import common, decontam, divergence, jaccard, packing, repeats, sanitise, token_orc, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def ids_of(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_encoding_is_exact(name, texts):
    encoder = tokens.Encoder(public_tokenizers.path(name))
    odd = ["a  b \n c", " \n", "x ", "İ!! ,", "<|endoftext|> a", "don't 's", "\x1c \x85", "é ́", "word" * 40, "A" * 30 + "…"]
    every = [t or "" for t in texts] + odd
    plain = encoder.tokenizer.encode_batch(every, add_special_tokens=False)
    assert encoder.encode([t.encode() for t in every]) == [np.array(e.ids, "<u4").tobytes() for e in plain]


class Counting:
    """A tokenizer that notes the texts it gets."""

    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def encode_batch_fast(self, texts, **options):
        self.seen += texts
        return self.inner.encode_batch_fast(texts, **options)


def counted(name, *before):
    encoder, seen = tokens.Encoder(public_tokenizers.path(name)), []
    encoder.encode([t.encode() for t in before])
    for part in ("tokenizer", "merges"):
        if hasattr(encoder, part):
            setattr(encoder, part, Counting(getattr(encoder, part), seen))
    return encoder, seen


def test_words_with_marks_are_not_encoded_again():
    encoder, seen = counted("word_bpe_49k.json", "alpha straße ,")
    got = encoder.encode(["Alpha, stra\u00dfe, alpha###".encode()])
    assert got[0] + np.uint32(2).tobytes() == ids_of("word_bpe_49k.json", "Alpha, stra\u00dfe, alpha###").tobytes()
    assert seen == ["###"]


def test_words_at_line_ends_are_not_encoded_again():
    encoder, seen = counted("byte_bpe_50k.json", "The alpha stra\u00dfe beta.\nThe")
    text = "The alpha.\nThe stra\u00dfe!!\nThe beta alpha!!\n"
    assert encoder.encode([text.encode()])[0] + np.uint32(2).tobytes() == ids_of("byte_bpe_50k.json", text).tobytes()
    assert seen == ["!!"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_of_letters_marks_and_white_space(name, texts):
    rng, encoder = random.Random(3), tokens.Encoder(public_tokenizers.path(name))
    some = [*"abzAZ09.,;:!?'#$%&*_-~<>|/\u00c0\u00d7\u00df\u00e9\u00f7\u00ff\u00b5\u00aa\u0130\u0131\u03a3\u03c3\u0301\u00ad\u00a0\u0085\u2009\u3000\u200b\u212a\u1e9e\u0416\u4e2d\U0001f600", "a\u0301", "e\u0300", "'s", "'ll", "\x1c", "\x0b"]
    parts = [*some, *some, *" \n\t", *[" "] * 40, *["the", "Erble", "\u00dcber", "estra\u00dfe", ".\n", "\n", ".\n\n", " \n", "\r\n"] * 4]
    every = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)] + ["", " ", "  ", "\n", " a", "  a", "a ", "a  ", "a\n ", "\u00a0 a \u00a0b"]
    plain = encoder.tokenizer.encode_batch(every, add_special_tokens=False)
    for _ in range(2):
        for text, got, e in zip(every, encoder.encode([t.encode() for t in every]), plain, strict=True):
            assert got == np.array(e.ids, "<u4").tobytes(), repr(text)
    assert encoder.encode([]) == [] and encoder.encode([b"", b""]) == [b"", b""]


def test_orc_round_trip(spark, docs, texts, tmp_path):
    target = f"file://{tmp_path}/orc"
    token_orc.write(docs, target, public_tokenizers.path("word_bpe_49k.json"))
    got, start = by_id(token_orc.digests(spark, target)), 0
    for i, t in enumerate(texts):
        ids = ids_of("word_bpe_49k.json", t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = token_orc.read(spark, target, F.col("doc_id") == 7)
    assert [r.doc_id for r in one.collect()] == [7] and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString()


def test_orc_repeats_and_empty(spark, docs, nothing, tmp_path):
    twice = docs.where("doc_id < 4").unionByName(docs.where("doc_id < 4")).withColumn("doc_id", F.nullif("doc_id", F.lit(3)))
    token_orc.write(twice, f"file://{tmp_path}/twice", public_tokenizers.path("word_bpe_49k.json"))
    rows = token_orc.digests(spark, f"file://{tmp_path}/twice").collect()
    assert len(rows) == 8 and sorted(r.start for r in rows)[0] == 0 and len({r.start for r in rows}) == 8
    token_orc.write(nothing, f"file://{tmp_path}/none", public_tokenizers.path("word_bpe_49k.json"))
    assert token_orc.digests(spark, f"file://{tmp_path}/none").count() == 0


def js(p, q):
    keys = set(p) | set(q)
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in keys}
    kl = lambda a: sum(a[k] * np.log2(a[k] / m[k]) for k in a if a[k] > 0)
    return float(np.sqrt(max(0, (kl(p) + kl(q)) / 2)))


def test_divergence(docs, texts, nothing):
    got = by_id(divergence.judge(docs))
    counts = collections.Counter(w for i, t in enumerate(texts) if i % 3 for w in WORD.findall(lower(t or "")))
    total = sum(counts.values())
    top = sorted((w for w in counts if counts[w] >= divergence.LEAST_SHARE * total), key=lambda w: (-counts[w], w))[: divergence.COMMON_WORDS]
    share = lambda c, n: {w: c[w] / n for w in top if c[w]} | {None: (n - sum(c[w] for w in top)) / n}
    for i, t in enumerate(texts):
        words, r = WORD.findall(t or ""), got[i]
        grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {p + k for p, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.kept and r.base_failed)
        if words:
            own = collections.Counter(WORD.findall(lower(t)))
            assert abs(r.word_distance - js(share(own, len(words)), share(counts, total))) < 1e-6
    assert divergence.judge(nothing).count() == 0


def test_divergence_of_mislabelled_texts(spark):
    rng = np.random.default_rng(11)
    shares = 1 / np.arange(1, 41)

    def text(lang, n):
        """About 30 % of the words are among 40 common ones."""
        often = rng.choice(40, n, p=shares / shares.sum())
        return " ".join(f"{lang}{a}" if x < 0.3 else f"{lang}rare{b}" for a, b, x in zip(often, rng.integers(0, 30_000, n), rng.random(n), strict=True))

    rows = [(i, text("ab"[i % 2], n), "ab"[i % 2]) for i, n in enumerate(rng.integers(100, 900, 1200).tolist())]
    wrong = [(10_000 + i, text("ab"[i % 2], n), "ba"[i % 2]) for i, n in enumerate(rng.integers(100, 900, 100).tolist())]
    strange = [(20_000 + i, " ".join(f"z{k}" for k in rng.integers(0, 30_000, n)), "ab"[i % 2]) for i, n in enumerate(rng.integers(100, 900, 40).tolist())]
    open_ = [(30_000 + i, text("a", 300), None) for i in range(20)] + [(31_000, " ".join(f"q{k}" for k in range(300)), None)]
    got = by_id(divergence.judge(spark.createDataFrame([*rows, *wrong, *strange, *open_], "doc_id long, text string, lang string")))
    assert not any(got[i].kept for i, _, _ in [*wrong, *strange]) and not got[31_000].kept
    assert sum(got[i].kept for i, _, _ in rows) >= 0.98 * len(rows) and sum(got[30_000 + i].kept for i in range(20)) >= 18


def test_divergence_limit_withstands_a_group_of_near_copies():
    plain = {b: (0.25 - 0.01 * b, 0.26 - 0.01 * b, 500) for b in range(9)}
    limits = divergence.fences(plain | {4: (0.1, 0.1, 500)}, 0.4, 8)
    assert all(plain[b][1] + 0.03 < limits[b] < 0.35 for b in range(9)) and max(divergence.fences({}, 0.4, 3)) < 0.4


def test_repeats(docs, texts, nothing):
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            if (g := tuple(words[p : p + 20])) in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(g)
        kept = [w for w, x in zip(words, gone, strict=True) if not x]
        expected[i] = (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = by_id(repeats.report(docs))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == expected
    for r in repeats.removed(docs).collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == expected[r.doc_id][2]
        assert sum(s.e - s.s for s in r.spans) == r.n_removed
    assert repeats.report(nothing).count() == 0


def test_repeats_of_repeated_and_null_ids(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.report(rows).collect()}
    assert got == {None: 0, 1: 30, 2: 0}


def test_repeats_in_every_row_without_id_or_with_a_repeated_one(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (None, b), (None, b), (4, c), (4, a), (4, None), (9, f"x {c} y"), (-(2**63), b)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in repeats.report(table).collect()) == sorted(
        [("None", 30, 0), ("None", 30, 0), ("None", 30, 30), ("4", 30, 0), ("4", 30, 30), ("4", 0, 0), ("9", 32, 30), (str(-(2**63)), 30, 30)]
    )
    assert sorted(r.text for r in repeats.removed(table).collect()) == sorted(["", "", "", "", a, b, c, "x y"])


def components(sets, num, den):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def shingles(text, k):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[p : p + k]) for p in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard(docs, texts, nothing, k, num):
    sets = {i: shingles(t, k) for i, t in enumerate(texts)}
    whole = components(sets, num, 100)
    got = by_id(jaccard.clusters(docs, k, num, 100))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), whole[i]) for i, s in sets.items()}
    assert sorted(r.doc_id for r in jaccard.kept(docs, k, num, 100).collect()) == sorted(set(whole.values()))
    assert jaccard.clusters(nothing, k, num, 100).count() == 0


def test_jaccard_chain_without_common_centre(spark):
    """Neighbours link, the ends don't: one component all the same."""
    words = [f"u{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(12)] + [(None, " ".join(words[48:148])), (50, "x"), (50, "x")]
    got = {r.doc_id: r.component_id for r in jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == dict.fromkeys([*range(12), None]) | {50: 50}


def test_jaccard_of_rows_without_id_or_with_a_repeated_one(spark):
    a, b, c = ([f"{x}{i}" for i in range(120)] for x in "abc")
    near = lambda words: " ".join([*words[:-1], "other"])
    a, b, c, a2, b2, c2 = *map(" ".join, (a, b, c)), near(a), near(b), near(c)
    rows = [(None, a, 1), (None, b, 2), (None, b2, 3), (5, a2, 4), (5, c, 5), (5, c, 6), (6, c2, 7), (6, "of its own", 8), (7, None, 9), (7, None, 10)]
    table = spark.createDataFrame(rows, "doc_id long, text string, at long").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.clusters(table, 3, 90, 100).collect())
    assert got == sorted([("None", 118, "None")] * 3 + [("5", 118, "None")] + [("5", 118, "5")] * 2 + [("6", 118, "5"), ("6", 1, "6")] + [("7", 0, "7")] * 2)
    rest = jaccard.kept(table, 3, 90, 100)
    assert rest.columns == table.columns
    left = {r["at"] for r in rest.collect()}
    assert left in ({1, 2, 8, 9, 10, x} for x in (5, 6))


@pytest.mark.parametrize("limit", [3, 1000])
def test_jaccard_of_families_dealt_to_several_tasks(spark, monkeypatch, limit):
    """Three families around a text each, many not linked with their centre; a star may have ``limit`` members a task."""
    monkeypatch.setattr(jaccard, "PART_ROWS", limit)
    rng, rows = random.Random(11), []
    common_part = [f"c{i}" for i in range(120)]
    for family in range(3):
        base = common_part + [f"f{family}w{i}" for i in range(60)]
        for variant in range(4):
            words = list(base)
            for at in rng.sample(range(len(words)), 4):
                words[at] = f"v{family}.{variant}.{at}"
            for _ in range(8):
                own = list(words)
                for at in rng.sample(range(len(own)), rng.randint(0, 3)):
                    own[at] = rng.choice(["x", "y", f"z{at}"])
                rows.append((len(rows), " ".join(own)))
    sets = {i: shingles(t, 3) for i, t in rows}
    whole = components(sets, 90, 100)
    assert 3 < len(set(whole.values())) < len(rows)
    got = by_id(jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100))
    assert {i: r.component_id for i, r in got.items()} == whole


def test_sketch_blocks_of_linked_sets_meet():
    rule, rng = jaccard.Rule(5, 80, 100), np.random.default_rng(3)
    for size in (3, 8, 20, 57, 300, 1500):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size, np.uint64))
            lost = int(len(a) * rng.uniform(0, 0.11))
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**63, lost, np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 80 * (len(a) + len(b) - shared) or lost == 0:
                continue
            doc, keys, spare, own = jaccard.block_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), rule)
            x, y = (set(keys[(doc == i) & (own | own[doc != i].all())].tolist()) for i in (0, 1))
            assert len(set(keys[doc == 0].tolist()) & set(keys[doc == 1].tolist())) > spare.min() + rule.classes(np.array([max(len(a), len(b))]))[0, 0]


@pytest.mark.parametrize("rule", [jaccard.Rule(5, 80, 100), jaccard.Rule(3, 90, 100)])
def test_sketch_blocks_of_texts_without_a_common_ngram_do_not_meet(rule):
    """Chance meetings would grow with the square of the number of texts."""
    size, texts = 300, 1000
    hashes = np.sort(np.random.default_rng(4).integers(0, 2**64, (texts, size), np.uint64, endpoint=False), axis=1).ravel()
    doc, keys, _, _ = jaccard.block_keys(hashes, np.arange(texts + 1) * size, rule)
    heavy = keys[keys & np.uint64(2) == 0]
    assert len(heavy) > 25 * texts and len(np.unique(heavy)) == len(heavy)


def test_jaccard_compares_a_family_with_its_centres_only(spark, monkeypatch):
    """Of a family of near copies not all pairs are compared."""
    rng, base = random.Random(12), [f"b{i}" for i in range(300)]
    rows = []
    for i in range(30):
        words = list(base)
        for at in rng.sample(range(300), 2):
            words[at] = f"v{i}.{at}"
        rows.append((i, " ".join(words)))
    plain, sent = jaccard._compared, []
    monkeypatch.setattr(jaccard, "_compared", lambda stars, *more: sent.append(stars.count()) or plain(stars, *more))
    whole = components({i: shingles(t, 3) for i, t in rows}, 90, 100)
    got = by_id(jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100))
    assert {i: r.component_id for i, r in got.items()} == whole
    assert sum(sent) < 30 * 29 / 4


def test_packing(docs, texts, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows, bins = packing.pack(docs, path, shard_pieces=40).collect(), collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t in enumerate(texts):
        ids, at = ids_of("byte_bpe_50k.json", t), 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 1024 or k == 0)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 3
    assert packing.pack(nothing, path).count() == 0


def test_local_search_beats_its_start():
    lengths = [600, 500, 424, 524, 300, 212, 512, 724]
    start = packing.best_fit(lengths, 1024)
    after = packing.improve([[0], [1, 2], [3, 4], [5, 6], [7]], lengths, 1024)
    assert len(after) <= 5 and len(start) <= 5
    assert sorted(i for b in after for i in b) == list(range(8)) and all(sum(lengths[i] for i in b) <= 1024 for b in after)


def test_toxicity(spark, nothing):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = [f"n{k}" for k in rng.integers(0, 400, 30)] + ([f"bad{k}" for k in rng.integers(0, 12, 3)] if toxic else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (0, rows[0][1])]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    got = toxicity.predict(spark, docs, marks).collect()
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [r.predicted == (r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id < 900]
    assert sum(right) / len(right) > 0.97
    weights = toxicity.fit(docs, marks)
    assert 0 < np.count_nonzero(weights) < 4000
    assert toxicity.accepted(docs, weights).columns == docs.columns
    empty = toxicity.fit(nothing, marks.limit(0))
    assert not empty.any() and {r.score for r in toxicity.score(docs, empty).collect()} == {0.5}
    assert toxicity.score(nothing, weights).count() == 0


def test_toxicity_is_plain_ftrl():
    """The same learner over dictionaries of unhashed features."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["Ab", "cd", "abcdefg", "abcdeff", "x1", "é"], rng.integers(0, 9)))) for i in range(80)]
    marks = {i: int("x1" in t and i % 7 > 0) for i, t in rows}

    def plain(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        out = {("", 0), *((w, 0) for w in words), *((w.encode()[:n], n) for w in words for n in toxicity.HEADS)}
        return out | {(a, b, 1) for a, b in zip(words, words[1:], strict=False)} | {(a, b, 2) for a, b in zip(words, words[2:], strict=False)}

    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0)) <= 1.0:
            return 0.0
        return (np.sign(z[f]) * 1.0 - z[f]) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    def said(t):
        return 1 / (1 + np.exp(-sum(weight(f) for f in plain(t))))

    seen = [(toxicity.coordinates([t.encode()])[0], marks[i]) for i, t in rows]
    w = toxicity.learned(seen, toxicity.Ftrl(l1=1.0), toxicity.EPOCHS)
    for _ in range(toxicity.EPOCHS):
        for i, t in rows:
            g = said(t) - marks[i]
            step = {f: (weight(f), n.get(f, 0.0)) for f in plain(t)}
            for f, (old, m) in step.items():
                z[f] = z.get(f, 0.0) + g - ((m + g * g) ** 0.5 - m**0.5) / toxicity.ALPHA * old
                n[f] = m + g * g
    got = toxicity.scores([t.encode() for _, t in rows], w)
    assert np.allclose(got, [said(t) for _, t in rows], atol=1e-9) and np.ptp(got) > 0.5


def test_toxicity_sample(spark):
    """Held-out, null and unlabelled ids teach nothing; repeated rows count once; null ids are not held out."""
    rows = [(i, f"bad{i % 3} word" if i % 2 else "fine word") for i in range(60)] * 2 + [(None, "bad0"), (None, None), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (7, None), (7, 0)], "doc_id long, toxic int")
    got = toxicity.sample(docs, marks).collect()
    assert {r.doc_id for r in got} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1} and len({r.doc_id for r in got}) == len(got)
    assert all(r._label == r.doc_id % 2 for r in got)
    full = toxicity.predict(spark, docs, marks).collect()
    assert len(full) == len(rows) and all(r.held_out is False for r in full if r.doc_id is None)
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}
    flipped = spark.createDataFrame([(i, 1 - i % 2 if held[i] else i % 2) for i in range(50)], "doc_id long, toxic int")
    kept = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert (toxicity.fit(docs, flipped) == toxicity.fit(docs, kept)).all()


def plain_spans(t):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def test_base_spans(texts):
    rng = np.random.default_rng(5)
    parts = ["a", "b.c", "@", "x.com", "-", ".", "10", "1.2.3.4", "255", "256", "4111111111111111", " ", "+", "(555)", "é", "٣", "%", "_"]
    for t in [t or "" for t in texts] + ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(4000)]:
        assert sanitise.base_spans(t.encode()) == plain_spans(t), t


def test_sanitise(spark, nothing, docs):
    secret = [(i, f"zorp quux{i} mail boss@corp.example about flim{i} the the") for i in range(8)]
    plain = [(100 + i, f"the plain words number{i} the mail about zorps") for i in range(200)]
    table = spark.createDataFrame([*secret, *plain, (999, None)], "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = by_id(sanitise.report(table))
    assert got[0].spans.split(",")[0] == "term:0:4" and got[0].n_email == 1
    assert got[0].base_sha256 == hashlib.sha256(b"email:16:33").hexdigest()
    assert all(got[100 + i].spans == "" for i in range(200)) and got[999].spans == ""
    clean = by_id(sanitise.sanitise(table))
    assert "boss@corp.example" not in clean[0].text and "[EMAIL]" in clean[0].text and "zorp " not in clean[0].text
    assert clean[0].n_chars == len(clean[0].text) and clean[999].text is None and clean[100].text == plain[0][1]
    assert sanitise.report(nothing).count() == 0
    assert sanitise.sanitise(docs).columns == docs.columns


def test_sanitise_of_entities_in_few_documents(spark):
    """A name at the top gives the address in the footer away, though it stands in one or two documents and far off."""
    middle = "the plain words of every letter " * 30
    few = [(0, f"Xaverius {middle} mail once@corp.example"), (1, f"Yolandette {middle} mail pair@corp.example"), (2, f"Yolandette {middle} mail pair@corp.example")]
    plain = [(100 + i, f"Wilhelm {middle} mail number{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(400)]
    table = spark.createDataFrame([*few, *plain], "doc_id long, text string")
    got = by_id(sanitise.report(table))
    assert [got[i].spans.split(",")[0] for i in range(3)] == ["term:0:8", "term:0:10", "term:0:10"]
    assert all(got[i].spans.count(",") == 1 for i in range(3)) and not any(got[100 + i].spans for i in range(400))


def test_sanitise_of_rows_with_one_id(spark):
    """A row has the terms of its own entities alone, not those of other rows with its id."""
    rows = [*[(None, "Xaverius wrote from once@corp.example")] * 3, (None, "Xaverius wrote from pair@corp.example")]
    rows += [*((1000 + i, "wrote from pair@corp.example") for i in range(39)), *((i, "wrote from") for i in range(410))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.text for r in sanitise.sanitise(table).where("doc_id is null").collect())
    assert got == ["Xaverius wrote from [EMAIL]", *["[TERM] wrote from [EMAIL]"] * 3]


def test_maybe_misses_no_base_span(texts):
    rng = np.random.default_rng(6)
    parts = ["a", "b.c", "@", "x.com", "-", ".", "10", "1.2.3.4", "255", "4111111111111111", " ", "+", "(555)", "é"]
    for t in [t or "" for t in texts] + ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(4000)]:
        assert not sanitise.base_spans(t.encode()) or "@" in t or re.search(sanitise._MAYBE, t), t


def test_sanitise_against_plain_counts(spark, texts):
    """Entities in one to many documents, words from rare to common, repeated rows; every figure anew from the docstring."""
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(texts[:90])]
    for i in range(700):
        words = [f"word{chr(97 + int(rng.expovariate(0.08)) % 26)}{chr(97 + rng.randrange(26) % 7)}" for _ in range(25)]
        if rng.random() < 0.4:
            e = int(rng.expovariate(0.1))
            words.insert(rng.randrange(25), f"who{e}@corp.example")
            words.insert(rng.randrange(25), f"Holder{'xyz'[e % 3]}{'abcdefgh'[e % 8]}")
        if rng.random() < 0.05:
            words.append("+1 (375) 555-4393, +1.2.3.4.5.6.7.8.9.0 a@b.co")
        rows.append((1000 + i, " ".join(words)))
    rows += [(rng.choice([None, 5000]), rng.choice(rows)[1]) for _ in range(60)]
    held, free, df, n_e, n_et = [], [], collections.Counter(), collections.Counter(), collections.Counter()
    for _, t in rows:
        t = t or ""
        spans = plain_spans(t)
        words = {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t)}
        mine = {(kind, t[s:e].lower()) for s, e, kind in spans}
        loose = [m for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(s < m.end() and m.start() < e for s, e, _ in spans)]
        held.append(mine)
        free.append(loose)
        df.update(words)
        n_e.update(mine)
        n_et.update((e, w) for e in mine for w in {m[0].lower() for m in loose})
    total, expected, added = len(rows), [], 0
    for (_, t), mine, loose in zip(rows, held, free, strict=True):
        told = {w for e in mine for w in {m[0].lower() for m in loose} if n_e[e] < total and 1 - np.log((df[w] + 1) / (n_et[e, w] + n_e[e] / total)) / np.log(total / n_e[e]) >= 0.8}
        spans = [(s, sanitise.KINDS.index(kind), e, kind) for s, e, kind in plain_spans(t or "")]
        more = [(m.start(), 9, m.end(), "term") for m in loose if m[0].lower() in told]
        added += len(more)
        expected.append(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans + more)))
    assert 50 < added < sum(map(len, free)) / 4
    got = sanitise.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == sorted((str(i), x) for (i, _), x in zip(rows, expected, strict=True))


def test_long_digit_runs_take_no_square_time():
    run = b"1" * 300_000
    assert sanitise.base_spans(run) == [] and sanitise.base_spans(run + b".2.3.4 10.0.0.1")[0][2] == "ip"


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, docs, texts, nothing):
    words = TERM.findall(lower(texts[10]))
    items = [(1, " ".join(words[3:20])), (2, "one, TWO"), (3, None), (4, ""), (5, "?!"), (6, "ECHO " * 12), (7, " ".join(words[3:13])), (8, "never seen words at all in here my dear old friend")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = TERM.findall(lower(t or ""))
        for p in range(max(0, len(w) - min(10, len(w)) + 1) if w else 0):
            windows[tuple(w[p : p + min(10, len(w))])].add(i)
    expected = {}
    for d, t in enumerate(texts):
        w, hit, found = TERM.findall(lower(t or "")), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in windows:
                    hit |= set(range(p, p + size))
                    found |= windows[tuple(w[p : p + size])]
        expected[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(docs, bench).collect()}
    assert got == expected
    in_blocks = decontam.find(docs, bench, block_bytes=60)
    assert {r.doc_id: (r.n_words, sum(x.e - x.s for x in r.runs), len(r["items"])) for r in in_blocks.collect()} == {d: v[:3] for d, v in expected.items()}
    longest = [m for r in decontam.find(docs, bench).where("doc_id = 10").collect() for m in r.matches if m.item_id == "1"]
    assert [(m.doc_start, m.item_start, m.length) for m in longest] == [(3, 0, 17)]
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, v in expected.items() if not v[4]}
    assert decontam.report(nothing, bench).count() == 0
    assert not any(r.contaminated for r in decontam.report(docs, bench.limit(0)).collect())


def test_decontamination_in_blocks_judges_each_row(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "vw")
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    rows = [(None, a), (None, f"{b} end"), (None, "clean"), (3, a), (3, "clean too"), (4, f"{a} {b}"), (4, f"{a} {b}")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    said = lambda df: sorted((str(r.doc_id), r.n_words, sum(x.e - x.s for x in r.runs), sorted(r["items"])) for r in df.collect())
    whole = said(decontam.find(table, bench))
    assert len(whole) == 7 and said(decontam.find(table, bench, block_bytes=8)) == whole


def test_scratch_follows_the_session(spark):
    assert common.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
