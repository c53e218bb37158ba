"""Media, archives, classifiers and the pipeline: round trips, held-out accuracy, plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import archive, compression, queries, toxicity, webp
from gridloom.llm.common import Scratch, fit_logistic, logistic
from webp_streams import finish, numbers, start, write_image

ODD = [None, "", "   \n\t ", "one", "one", "é" * 3000, "a b c d e f " * 900, "x" * 191, "x" * 192, "x" * 193, "tab\x00\x1c and 日本 😀"]
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, media binary")


def docs_of(spark, texts):
    return frame(spark, [(i, t, "en", 1.0, None) for i, t in enumerate(texts)])


def picture(h, w, seed=1, colours=None):
    r = np.random.default_rng(seed)
    if colours:
        return r.integers(0, 256, (colours, 4))[r.integers(0, colours, (h, w))].astype(np.uint8)
    p = np.cumsum(r.integers(-3, 4, (h, w, 4)), axis=1) + np.cumsum(r.integers(-3, 4, (h, w, 4)), axis=0)
    p[: h // 3, : w // 2] = 7
    return (p & 255).astype(np.uint8)


@pytest.mark.parametrize("cache,copies,block", [(0, False, None), (0, True, None), (4, False, None), (6, True, None), (3, True, 2), (0, False, 3)])
def test_prefix_codes_copies_and_cache(cache, copies, block):
    for p in (picture(23, 37), picture(9, 200, colours=5), picture(1, 1)):
        out = start(p.shape[1], p.shape[0])
        out.put(0, 1)
        write_image(out, numbers(p), True, cache, copies, block)
        assert (webp.decode(finish(out)) == p).all()
        assert (webp.decode_all([finish(out)])[0] == p).all()


def test_every_predictor():
    p = picture(12, 15).astype(np.int64)
    h, w, _ = p.shape
    avg = lambda a, b: (a + b) // 2
    for mode in range(14):
        left = np.zeros_like(p)
        for y in range(h):
            for x in range(w):
                if x == 0 and y == 0:
                    q = np.array([0, 0, 0, 255])
                elif y == 0:
                    q = p[0, x - 1]
                elif x == 0:
                    q = p[y - 1, 0]
                else:
                    a, t, c = p[y, x - 1], p[y - 1, x], p[y - 1, x - 1]
                    d = p[y - 1, x + 1] if x + 1 < w else p[y, 0]
                    half = avg(a, t)
                    q = [
                        np.array([0, 0, 0, 255]), a, t, d, c, avg(avg(a, d), t), avg(a, c), half, avg(c, t), avg(t, d), avg(avg(a, c), avg(t, d)),
                        a if sum(abs(int(v)) for v in (a + t - c) - a) < sum(abs(int(v)) for v in (a + t - c) - t) else t,
                        np.clip(a + t - c, 0, 255), np.array([min(255, max(0, int(m) + int((int(m) - int(k)) / 2))) for m, k in zip(half, c)]),
                    ][mode]
                left[y, x] = p[y, x] - q & 255
        out = start(w, h)
        out.put(1, 1), out.put(0, 2), out.put(0, 3)
        write_image(out, np.full((h + 3 >> 2, w + 3 >> 2), mode << 8))
        out.put(0, 1)
        write_image(out, numbers(left), True)
        assert (webp.decode(finish(out)) == p).all(), mode


def test_subtract_green_and_cross_colour():
    p = picture(10, 13).astype(np.int64)
    signed = lambda x: (x + 128) % 256 - 128
    rb, gb, gr = 17, 250, 99
    out = start(13, 10)
    out.put(1, 1), out.put(1, 2), out.put(1, 3)
    write_image(out, np.full((2, 2), rb << 16 | gb << 8 | gr))
    out.put(1, 1), out.put(2, 2), out.put(0, 1)
    q = p.copy()
    q[..., 2] = p[..., 2] - (signed(gb) * signed(p[..., 1]) // 32) - (signed(rb) * signed(p[..., 0]) // 32) & 255
    q[..., 0] = p[..., 0] - (signed(gr) * signed(p[..., 1]) // 32) & 255
    q[..., 0], q[..., 2] = q[..., 0] - q[..., 1] & 255, q[..., 2] - q[..., 1] & 255
    write_image(out, numbers(q), True, 2, True)
    assert (webp.decode(finish(out)) == p).all()


@pytest.mark.parametrize("colours,pack", [(2, 3), (4, 2), (13, 1), (90, 0)])
def test_palettes(colours, pack):
    p = picture(11, 21, colours=colours)
    table, index = np.unique(p.reshape(-1, 4), axis=0, return_inverse=True)
    index, n = index.reshape(11, 21), len(table)
    if n > {3: 2, 2: 4, 1: 16, 0: 256}[pack]:
        pytest.skip("colours met twice")
    table = np.concatenate([table, np.repeat(table[-1:], colours - n, axis=0)]) if n < colours else table
    out = start(21, 11)
    out.put(1, 1), out.put(3, 2), out.put(len(table) - 1, 8)
    steps = np.diff(np.concatenate([np.zeros((1, 4), dtype=int), table.astype(int)]), axis=0) & 255
    write_image(out, numbers(steps[None]))
    out.put(0, 1)
    wide = -(-21 // (1 << pack))
    packed = np.zeros((11, wide), dtype=np.int64)
    for x in range(21):
        packed[:, x >> pack] |= index[:, x] << (8 >> pack) * (x & (1 << pack) - 1)
    write_image(out, packed << 8, True)
    assert (webp.decode(finish(out)) == p).all()


def test_media_columns_give_texts_back(spark):
    texts = ODD + ["z" * 700]
    rows = webp.media(docs_of(spark, texts))
    files = {r.doc_id: bytes(r.media) for r in rows.collect()}
    got = {r.doc_id: r for r in webp.media_digest(rows).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert webp.decode(files[i]).tobytes()[: len(payload)] == payload
        x = got[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (x.media_bytes, x.media_sha256) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())
    assert got[3].feature == got[4].feature and got[3].media_sha256 == got[4].media_sha256
    assert webp.payload_shape(192 * 16385) == (96, 8193)
    assert webp.media_digest(webp.media(frame(spark, []))).count() == 0


def test_grammars_expand_to_their_ids():
    r = np.random.default_rng(5)
    for ids in ([], [3], [7] * 5000, r.integers(0, 6, 4000), np.tile(r.integers(0, 50000, 70), 60)):
        ids = np.asarray(ids, dtype=np.int64)
        block = archive.Block(50257, *archive.pack_block(ids, 50257))
        assert (block.read(0, len(ids)) == ids).all()
        for a, n in ((0, 1), (5, 17), (len(ids) // 2, len(ids) // 3)):
            if a + n <= len(ids):
                assert (block.read(a, n) == ids[a : a + n]).all()
    assert len(archive.repair([7] * 5000, 50257)[0]) < 600


def test_archives_hold_every_document_in_order(spark):
    tokenizer = Tokenizer.from_file(archive.public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD + ["It's  12a3 don't\n\n x  \r\n<|endoftext|> __y!!", " lead", "naïve – “q”… ½ ¼a"]
    rows = docs_of(spark, texts).unionByName(frame(spark, [(3, "again", "x", None, None), (None, "no id", "x", None, None)]))
    path = f"{Scratch(spark).folder}/archive"
    archive.write_archive(rows, path, block_tokens=300, shard_bytes=2000)
    want = [(None, "no id")] + sorted([(i, t or "") for i, t in enumerate(texts)] + [(3, "again")])
    digest = archive.archive_digest(spark, path).orderBy("start").collect()
    full = archive.read_archive(spark, path).orderBy("start").collect()
    at = 0
    for (d, t), x, f in zip(want, digest, full):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        assert (x.doc_id, x.start, x.n_tokens) == (d, at, len(ids)) and f.ids == ids
        assert x.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert len(digest) == len(want)
    blocks = spark.read.parquet(path)
    assert archive.read_document(blocks, 6) == tokenizer.encode(texts[6], add_special_tokens=False).ids + [0]
    assert archive.read_document(blocks, 999) == []
    empty = f"{Scratch(spark).folder}/archive"
    archive.write_archive(frame(spark, []), empty)
    assert archive.archive_digest(spark, empty).count() == 0


def corpus(n, seed=1):
    """Good prose, shouted junk, and one toxic text in six; (doc_id, text, quality, toxic)."""
    r, out = random.Random(seed), []
    common = "the of and to in is it that was for on are with as he they at".split()
    for i in range(n):
        w = [r.choice(common) if r.random() < 0.6 else "".join(r.choice(("er", "an", "th", "on", "re", "ing", "st")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 120))]
        quality, toxic = int(r.random() > 0.3), int(r.random() < 0.17)
        if toxic:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(("blockhead", "nitwit", "vermin"))
        text = " ".join(w)
        out.append((i, text if quality else text.upper().replace(" ", "!! "), quality, toxic))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus(900)
    return frame(spark, [(i, t, "x", 0.0, None) for i, t, _, _ in rows]).cache(), spark.createDataFrame([(i, q, x) for i, _, q, x in rows], LABELS).cache(), rows


def test_compression_scores_hold_on_unseen_rows(spark, labelled):
    docs, labels, rows = labelled
    got = compression.quality(docs, labels).collect()
    truth = {i: q for i, _, q, _ in rows}
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
    unseen = [x for x in got if x.held_out]
    assert sum(x.predicted == truth[x.doc_id] for x in unseen) >= 0.97 * len(unseen)


def test_toxicity_scores_hold_on_unseen_and_misspelled_words(spark, labelled):
    docs, labels, rows = labelled
    got = toxicity.toxicity(docs, labels).collect()
    truth = {i: x for i, _, _, x in rows}
    unseen = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert sum(x.predicted == truth[x.doc_id] for x in unseen) >= 0.97 * len(unseen)
    model = toxicity.fit(docs, labels)
    lexicon = toxicity.FuzzyLexicon(model.words, model.stems, model.fuzzy)
    score = lambda t: logistic([lexicon.features(t)], np.array(model.weights))[0]
    filler = "the of and to in is it " * 6
    assert score(filler + "you b1ockhead") >= 0.3 > score(filler) and score(filler + 'he said "you blockhead" and') < score(filler + "you blockhead")


def test_fuzzy_lexicon_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    r = random.Random(1)
    terms = {"".join(r.choice("abc") for _ in range(r.randint(3, 9))): 1.0 + k for k in range(12)}
    lexicon = toxicity.FuzzyLexicon(terms, {})
    for _ in range(1500):
        word = "".join(r.choice("abcd") for _ in range(r.randint(1, 10)))
        near = [(distance(t, word), -w, t) for t, w in terms.items() if distance(t, word) <= toxicity.allowed_errors(t)]
        assert lexicon.find(word) == ((min(near)[2], min(near)[0]) if near else None)


@pytest.mark.parametrize("scored", [compression.quality, toxicity.toxicity])
def test_classifiers_take_odd_and_empty_tables(spark, labelled, scored):
    docs, labels, _ = labelled
    none = spark.createDataFrame([], LABELS)
    odd = docs_of(spark, ODD).unionByName(frame(spark, [(None, "x y", None, None, None), (3, "one", None, None, None)]))
    strange = spark.createDataFrame([(None, 1, 0), (3, None, None), (0, 1, 1), (0, 0, 0)], LABELS)
    for rows, marks in ((odd, none), (odd, strange), (docs.limit(0), none), (odd.unionByName(docs.withColumn("doc_id", docs.doc_id + 0)), labels)):
        got = scored(rows, marks).collect()
        assert len(got) == rows.count() and all(0 <= x.score <= 1 for x in got)


def test_logistic_fit_separates():
    x = np.array([[0.0], [1], [2], [3], [4], [5]])
    p = logistic(x, fit_logistic(x, [0, 0, 0, 1, 1, 1]))
    assert (np.diff(p) > 0).all() and p[2] < 0.5 < p[3]


def test_pipeline_equals_its_stages_on_a_small_corpus(spark, labelled, tmp_path):
    docs, labels, rows = labelled
    r = random.Random(3)
    more = [(1000 + i, t.replace(" the ", " a ", 1), "x", 0.0, None) for i, t, _, _ in r.sample(rows, 40)] + [(2000 + i, t, "x", 0.0, None) for i, t, _, _ in rows[:20]]
    folder = str(tmp_path)
    docs.unionByName(frame(spark, more)).select("doc_id", "text", "lang").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{name}")
        before, now = now, spark.read.parquet(f"{folder}/{name}")
        seen[name] = (before, now)
    assert len(corpus_pipeline.STAGES) == 4 and all(b.columns == a.columns for n, (b, a) in seen.items() if n != "packing")
    truth = {i: (q, x) for i, _, q, x in rows}
    good = {x.doc_id for x in seen["quality"][1].collect()}
    assert sum((i in good) == bool(truth[i][0]) for i in truth) >= 0.98 * len(truth)
    clean = {x.doc_id for x in seen["toxicity"][1].collect()}
    assert clean <= good and sum((i in clean) == (not truth[i][1]) for i in truth if i in good) >= 0.98 * sum(i in good for i in truth)
    from test_text_operators import groups

    left = sorted((x.doc_id, x.text) for x in seen["near_duplicates"][0].collect())
    root, _ = groups([t for _, t in left], 5, 80)
    assert {x.doc_id for x in seen["near_duplicates"][1].collect()} == {left[k][0] for k in set(root)}
    assert sorted(x.doc_id for x in seen["packing"][1].collect()) == sorted(x.doc_id for x in seen["near_duplicates"][1].collect())
    assert corpus_pipeline.run(spark, folder).count() == seen["packing"][1].count()


def test_queries_cover_the_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_payloads_reach_every_part_of_the_decoder_that_shortens_them():
    r = np.random.default_rng(3)
    words = ["".join(chr(97 + k) for k in r.integers(0, 26, r.integers(2, 9))) for _ in range(400)]
    prose = " ".join(r.choice(words, 700))
    prose += " " * (-len(prose) % 4)
    texts = {
        "literals": prose[:1500],
        "cache": prose + prose,
        "palette": "".join(r.choice(["abcd", "efgh", "ijkl"], 300)),
        "predictor": "".join(chr(0x430 + k) for k in r.integers(0, 32, 3000)),
        "subtract green": bytes((r.integers(4, 124, (4000, 1)) + r.integers(-3, 4, (4000, 4))).astype(np.uint8).ravel()).decode(),
        "long copies": "x" * 40000 + prose + "y" * 40000,
    }
    payloads = [webp.padded(t.encode()) for t in texts.values()]
    files = webp.write_payloads(payloads)
    for (name, text), p, f, pixels in zip(texts.items(), payloads, files, webp.decode_all(files)):
        assert pixels.tobytes()[: len(p)] == p == webp.decode(f).tobytes()[: len(p)], name
        assert webp.write_payloads([p]) == [f], name
        data = webp._image_data(f)
        opened = webp.Opened(data, *webp._head(webp.Bits(data)))
        used = opened.names + (["cache"] if opened.cache else [])
        assert name in used or (name == "literals" and not used) or (name == "long copies" and used == ["cache"]), (name, used)


def plain_repair(ids, base, least=8, gain=0.02, rounds=16):
    """The rounds of ``archive.repair`` on lists, with exact counts."""
    seq, rules = list(ids), []
    for _ in range(rounds):
        pairs = list(zip(seq, seq[1:]))
        span = base + len(rules)
        often = sorted((-n, a * span + b) for (a, b), n in Counter(pairs).items() if n >= least)
        if len(seq) < 2 * least or not often:
            break
        rank = {divmod(code, span): k for k, (_, code) in enumerate(often)}
        at = [rank.get(p, len(rank)) for p in pairs]
        runs = [0] * len(at)
        for i in range(1, len(at)):
            runs[i] = runs[i - 1] + 1 if at[i] == at[i - 1] else 0
        around = [len(rank), *at, len(rank)]
        chosen = [i for i, k in enumerate(at) if k < len(rank) and around[i] >= k <= around[i + 2] and runs[i] % 2 == 0]
        uses = Counter(at[i] for i in chosen)
        chosen = [i for i in chosen if uses[at[i]] >= 2]
        if len(chosen) < gain * len(seq):
            break
        new = sorted(pairs[i] for i in {at[i]: i for i in chosen}.values())
        rules += new
        gone, named = {i + 1 for i in chosen}, {i: span + new.index(pairs[i]) for i in chosen}
        seq = [named.get(i, s) for i, s in enumerate(seq) if i not in gone]
    return seq, rules


@pytest.mark.parametrize("symbols", [2, 3, 5])
def test_repair_makes_the_grammar_of_the_plain_rounds(symbols):
    r = np.random.default_rng(symbols)
    ids = np.concatenate([r.integers(0, symbols, 900), np.ones(41, dtype=int), r.integers(0, symbols, 200)])
    seq, rules, _ = archive.repair(ids, 50257, rounds=1)
    want, made = plain_repair(ids.tolist(), 50257, rounds=1)
    assert len(seq) == len(want) and sorted(map(tuple, rules.tolist())) == made
    assert archive.expand(seq, rules, 50257).tolist() == ids.tolist()
