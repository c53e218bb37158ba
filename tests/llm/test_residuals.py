import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import residuals
from gridloom.llm.encoding import TokenBytes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(4)
    for capacity in (7, 64, 2048):
        lengths = sorted((rng.randint(1, capacity) for _ in range(600)), reverse=True)
        places, fill = residuals.best_fit(lengths, capacity)
        room = []
        for n, (k, offset) in zip(lengths, places):
            fits = [r for r in room if r >= n]
            if fits:
                assert room[k] == min(fits)
            else:
                assert k == len(room)
                room.append(capacity)
            assert offset == capacity - room[k]
            room[k] -= n
        assert [capacity - r for r in room] == fill and min(room) >= 0


def sound(placed, capacity):
    """Sequences are gapless from 0 and not over-full; how many there are."""
    at = {}
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in at.values())
    return len(at)


def test_tree_packs_nearly_as_well_as_one_leaf(spark):
    """Leaves of two hundred items and parents of three children; the same sizes with a single hot one."""
    for sizes in ("1 + pmod(hash(id, 7), 60)", "1 + pmod(hash(id, 7), 30) * pmod(id, 3)", "60", "64", "33", "1"):
        items = spark.range(3000).selectExpr("id as item", f"cast({sizes} as long) as length")
        length = {r.item: r.length for r in items.collect()}
        counts = []
        for leaf, fan in ((1 << 15, 64), (200, 3)):
            rows = residuals.pack(items, 64, leaf, fan).join(items, "item").collect()
            assert sorted(r.item for r in rows) == list(range(3000))
            counts.append(sound(rows, 64))
        least = -(-sum(length.values()) // 64)
        assert least <= counts[0] <= counts[1] <= 1.06 * counts[0] + 1


def docs():
    rng = random.Random(9)
    words = ["alpha", " beta", "Überschrift", "\n", "東京", " 1234", "'ll", "  ", "\t", "naïve", "🙂", "<|endoftext|>"]
    texts = ["".join(rng.choices(words, k=rng.choice([1, 5, 40, 300]))) for _ in range(120)]
    texts += [None, "", "same text", "same text", "word " * 20_000, " " * 5000, "x" * 3000, "a<|endoftext|>b"]
    return [(None if i == 7 else i % 125, t, "q", 1.0) for i, t in enumerate(texts)]


def test_pieces_and_sequences_equal_the_library(spark):
    rows = docs()
    tokenizer = Tokenizer.from_file(PATH)
    whole = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, _, _ in rows]
    want = []
    for d, ids in whole:
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        want += [(d, k, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length double").repartition(5)
    packed = residuals.packed_pieces(df, capacity=256, with_ids=True, leaf=40, fan=2).cache()
    got = packed.collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    n = sound(got, 256)
    assert n <= 1.05 * sum(len(i) for _, i in whole) / 256 + 2
    built = {r.sequence_id: r for r in residuals.sequences(packed).collect()}
    assert len(built) == n
    for r in got:
        assert built[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
        assert len(built[r.sequence_id].ids) == 4 * built[r.sequence_id].n_tokens


def test_encoder_equals_an_untouched_tokenizer():
    rng, tokenizer, encoder = random.Random(2), Tokenizer.from_file(PATH), TokenBytes(PATH)
    letters = "abcXYZ éßÆ0129²½ \t\n\r'.,-–—…!?\"$%_ " + "日本̀​"
    for k in range(3000):
        text = "".join(rng.choices(letters[: -4 if k % 2 else None], k=rng.randint(0, 60)))
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(None) == b""


def test_empty_table(spark):
    assert residuals.packed_pieces(spark.createDataFrame([], "doc_id string, text string")).collect() == []
