"""Near duplicates, word pieces, licences, rules, sampling and packing against plain versions."""

import collections
import itertools
import math
import random
import re

import pytest

from gridloom.llm import dedup, licences, packing, sampling, weaksup, wordpieces

WORDS = [f"w{i}" for i in range(60)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, node string")


def docs_of(spark, texts):
    return frame(spark, [(i, t, "en", 1.0, "x") for i, t in enumerate(texts)])


ODD = [None, "", "   \n\t ", "one", "one", "One", "two words", "TWO words", "é" * 3000, "a b c d e f " * 900]


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def groups(texts, size, percent):
    sets, root = [shingles(t, size) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_copies(seed):
    r = random.Random(seed)
    texts = list(ODD)
    for _ in range(25):
        texts.append(" ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(r.randint(1, 160))))
    base = [f"b{r.randint(0, 300)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(55))
    for _ in range(45):  # a group of near copies longer than a short list, and texts that share a passage
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(len(copy))] = f"e{r.randint(0, 10**6)}"
        texts.append(" ".join(copy))
        texts.append(passage + " " + " ".join(f"q{r.randint(0, 10**6)}" for _ in range(r.randint(5, 60))))
    for t in texts[10:30]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += texts[12:15]
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    texts = near_copies(size)
    got = {r.doc_id: r for r in dedup.near_duplicates(docs_of(spark, texts), size).collect()}
    want, sizes = groups(texts, size, 80)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d", "x", 1.0, "n"), (None, "a b c d", "x", 1.0, "n"), (5, None, "x", 1.0, "n"), (5, "a b c d", "x", 1.0, "n"), (7, "a b c d", None, None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 5, False), (None, 5, False), (5, 5, True), (5, 5, True), (7, 5, False)], key=str)
    assert dedup.near_duplicates(frame(spark, [])).count() == 0
    kept = dedup.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "score", "node"] and [r.doc_id for r in kept.collect()] == [5, 5]


def test_retained_values_needed_are_below_the_expected_overlap():
    assert dedup.need(10, 80) == 8 and dedup.need(150, 80) == 120
    p = [math.comb(dedup.SKETCH, k) * 0.8**k * 0.2 ** (dedup.SKETCH - k) for k in range(dedup.SKETCH + 1)]
    assert sum(p[: dedup.need(dedup.FULL, 80)]) < 1e-5


def greedy(word, begin, inner):
    i = n = 0
    while i < len(word):
        v = inner if i else begin
        j = next((j for j in range(len(word), i, -1) if word[i:j] in v), None)
        if j is None:
            return 1, 1
        n, i = n + 1, j
    return n, 0


def test_longest_match_counts_equal_greedy_splitting():
    r = random.Random(3)
    for _ in range(400):
        letters = "abc"[: r.randint(1, 3)]
        begin, inner = ({"".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 8))} for _ in range(2))
        automaton = wordpieces.LongestMatch(sorted(begin), sorted(inner))
        for _ in range(20):
            word = "".join(r.choice(letters + "d" * (r.random() < 0.1)) for _ in range(r.randint(1, 14)))
            assert automaton.count(word) == greedy(word, begin, inner)


def test_token_counts_of_documents(spark):
    begin, inner = map(set, wordpieces.vocabulary())
    texts = ODD + ["The  quick\x0bbrown fox, 12 日本 jumps", "x" * 50000]
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in wordpieces.token_counts(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        counts = [(len(w) // max(1, len(w)), 0) if not w else greedy(w, begin, inner) for w in words] if len(t or "") < 20000 else None
        if counts is not None:
            assert got[i] == (len(words), sum(a for a, _ in counts), sum(b for _, b in counts))
    assert wordpieces.token_counts(frame(spark, [])).count() == 0


def contained(text, template):
    w, t = licences.template_words(text or ""), licences.template_words(template)
    k = licences.SHINGLE
    want, have = ({tuple(x[i : i + k]) for i in range(len(x) - k + 1)} for x in (t, w))
    return len(want & have) / len(want)


def test_licences_equal_containment_of_whole_short_texts(spark):
    r = random.Random(8)
    texts = list(ODD)
    for name in licences.TEMPLATES:
        for damage in (0, 1, 40):
            w = licences.TEMPLATES[name].split()
            for _ in range(damage):
                w[r.randrange(len(w))] = f"z{r.randint(0, 999)}"
            texts.append(" ".join(r.choice(WORDS) for _ in range(r.randint(0, 70))) + "\n" + " ".join(w) + " " + " ".join(r.choice(WORDS) for _ in range(r.randint(0, 70))))
    texts.append("This code has a licence of its own, not a license that software lists know")
    got = {(x.doc_id, x.licence) for x in licences.scan(docs_of(spark, texts)).collect()}
    want = {(i, n) for i, t in enumerate(texts) for n, m in licences.TEMPLATES.items() if contained(t, m) >= licences.CONTAINED}
    assert got == want and len(want) >= 12
    assert licences.scan(frame(spark, [])).count() == 0


def test_anchors_lose_nothing():
    chosen = set(licences.anchors(licences.TEMPLATES))
    for t in licences.TEMPLATES.values():
        w = licences.template_words(t)
        s = [w[i : i + 5] for i in range(len(w) - 4)]
        assert sum(not set(x) & chosen for x in s) < licences.CONTAINED * len(s)


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {k for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_rules_measure_whole_texts_and_find_junk(spark):
    r = random.Random(4)
    texts = list(ODD) + ["a b a b a b a", "x\nx\n\n \nx y\nx y", "# * $ % & | < > ! x"]
    clean = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) + str(r.randint(0, 40)) + "on" for _ in range(r.randint(60, 200))) + "." for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in t.split()) for t in clean[:6]] + [" ".join(w + "***" for w in t.split()) for t in clean[6:12]]
    texts += clean + junk
    got = {x.doc_id: x for x in weaksup.quality(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == plain_measures(t)
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
    k = len(texts) - len(junk)
    assert all(got[i].kept for i in range(k - len(clean), k)) and not any(got[i].kept for i in range(k, len(texts)))
    assert weaksup.quality(frame(spark, [])).count() == 0


def test_sampling_is_distinct_reproducible_and_proportional():
    segmenter = sampling.Segmenter(sampling.public_tokenizers.path("piece_bpe_32k.model"))
    edges, back = segmenter.lattice("the")
    paths = []

    def walk(at, ids, p):
        if at == len(edges):
            paths.append((tuple(ids), p))
        else:
            for j, own, q in edges[at]:
                walk(j, ids + list(own), p + q)

    walk(0, [], 0.0)
    assert math.isclose(math.log(sum(math.exp(p) for _, p in paths)), back[0], abs_tol=1e-9)
    chance, first = {i: math.exp(p - back[0]) for i, p in paths}, collections.Counter()
    for key in range(4000):
        got = segmenter.sample("the", key, 3)
        assert len({tuple(g[0]) for g in got}) == len(got) == 3
        assert [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        assert all(math.isclose(g[1], math.log(chance[tuple(g[0])]), abs_tol=1e-9) and 0 < g[3] <= 1 for g in got)
        first[tuple(got[0][0])] += 1
    for ids, p in chance.items():
        assert abs(first[ids] / 4000 - p) < 4 * math.sqrt(p * (1 - p) / 4000) + 1e-3
    assert segmenter.sample("the", 5, 3) == segmenter.sample("the", 5, 3)
    everything = segmenter.sample("the", 1, len(paths) + 5)
    assert len(everything) == len(paths) and all(g[3] == 1.0 for g in everything)


def test_sampled_rows_decode_to_their_texts(spark):
    texts = ODD[:9] + ["emoji 😀 and 日本 or é", "a  b "]
    got = sampling.sampled_segmentations(docs_of(spark, texts).withColumnRenamed("score", "ids"), ["doc_id"], k=2).collect()
    assert all(r.decoded_equal for r in got if "\n" not in (texts[r.doc_id] or "")) and {r.doc_id for r in got} == set(range(len(texts)))
    assert [(list(r.ids), r.log_prob, r.inclusion) for r in got if r.doc_id == 0] == [([], 0.0, 1.0)]
    assert sampling.sampled_segmentations(frame(spark, []), ["doc_id"]).count() == 0


def test_boundaries_are_optimal():
    r = random.Random(2)
    for _ in range(40):
        n, k = r.randint(1, 8), r.randint(1, 4)
        lengths = sorted(r.sample(range(1, 40), n))
        counts = [r.randint(1, 9) for _ in lengths]
        sums = [a * b for a, b in zip(lengths, counts)]
        ends, cost = packing.optimal_boundaries(lengths, counts, k)
        best = min(
            sum(min(e for e in [*c, lengths[-1]] if e >= a) * b for a, b in zip(lengths, counts)) - sum(sums)
            for m in range(min(k, n)) for c in itertools.combinations(lengths[:-1], m)
        )
        assert cost == best and len(ends) <= k and ends[-1] == lengths[-1]
        assert cost == sum(min(e for e in ends if e >= a) * b for a, b in zip(lengths, counts)) - sum(sums)


def test_boundaries_are_optimal_for_long_and_many_lengths():
    """Every distinct length may be a boundary, also beyond some thousands of words."""
    r = random.Random(3)
    for n, k, top in ((300, 7, 20_000), (200, 16, 1 << 40), (250, 3, 260)):
        lengths = sorted(r.sample(range(1, top), n))
        counts = [r.choice([1, 1, 1, 5, 400]) for _ in lengths]
        rows, tokens = [0, *itertools.accumulate(counts)], [0, *itertools.accumulate(a * b for a, b in zip(lengths, counts))]
        cost = lambda i, j: lengths[j] * (rows[j + 1] - rows[i]) - (tokens[j + 1] - tokens[i])
        best = [cost(0, j) for j in range(n)]
        for _ in range(k - 1):
            best = [min([cost(0, j)] + [best[i - 1] + cost(i, j) for i in range(1, j + 1)]) for j in range(n)]
        ends, found = packing.optimal_boundaries(lengths, counts, k)
        assert found == best[-1] == sum(min(e for e in ends if e >= a) * b for a, b in zip(lengths, counts)) - tokens[-1]


def test_batches_hold_the_budget_and_every_row(spark):
    r = random.Random(6)
    texts = ODD + ["x " * r.choice([3, 3, 3, r.randint(1, 400)]) for _ in range(300)]
    rows = docs_of(spark, texts).unionByName(docs_of(spark, texts[:5]))
    got = packing.pack(rows, buckets=4, budget=600).collect()
    assert len(got) == len(texts) + 5 and all(x.length == len((texts[x.doc_id] or "").split()) + 1 and x.padding == x.boundary - x.length >= 0 for x in got)
    batches = collections.defaultdict(list)
    for x in got:
        batches[x.bucket, x.batch_id].append(x)
    for own in batches.values():
        assert sorted(x.slot for x in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].boundary <= 600
    for bucket in {b for b, _ in batches}:
        sizes = [len(v) for (b, _), v in sorted(batches.items()) if b == bucket]
        assert len(set(sizes[:-1])) <= 1 and sorted(n for b, n in batches if b == bucket) == list(range(len(sizes)))
    assert packing.pack(frame(spark, [])).count() == 0


def test_a_clashing_column_does_not_disturb_the_near_duplicate_filter(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text, "a", 5), (2, text, "b", 6), (3, "something else altogether here now", "c", 7)], "doc_id long, text string, _kept string, kept int")
    assert sorted((r.doc_id, r["_kept"], r.kept) for r in dedup.drop_near_duplicates(df).collect()) == [(1, "a", 5), (3, "c", 7)]
