"""Sampled segmentations without replacement.

The pieces of a sentencepiece model that match a text form a lattice.  Backward
sums give every partial segmentation the probability mass of its completions; a
Gumbel value is drawn top down under the condition that the largest value of a
node's children is its own, and a best-first search pops partial segmentations by
that value.  Complete ones come out as a Gumbel top-k: distinct segmentations
sampled without replacement, in order.  The value that the next one would have
is the threshold of the inclusion probabilities.  Randomness depends on the row's
key and text alone.

A step draws which child has its parent's value; its siblings stay one group,
whose largest value is a Gumbel of their joint mass below the parent's, until the
search asks for it.  Groups below the k + 1 best open values are dropped: none of
them can come out.  No piece goes on behind a word, so sums are local to words
and remembered.

A BPE model has no piece probabilities; pieces count with a Zipf law of their
rank.  Letters without a piece become their UTF-8 byte pieces.
"""

import heapq
import itertools
import math
import random
import re

import pandas as pd
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import remembered

MARK = "▁"
ZIPF_SHIFT = 10.0
WORDS = 20_000  # word lattices remembered by a task; beyond, the memory starts anew


class Segmenter:
    """Lattice, search, encoding and decoding for one model file."""

    def __init__(self, path):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.trie, self.bytes = {}, {}
        usual = [i for i in range(len(self.pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        usual.sort(key=lambda i: (-model.get_score(i), i))
        total = sum(1 / (r + ZIPF_SHIFT) for r in range(len(usual)))
        for r, i in enumerate(usual):
            node = self.trie
            for c in self.pieces[i]:
                node = node.setdefault(c, {})
            node[""] = i, -math.log((r + ZIPF_SHIFT) * total)
        self.rare = -math.log(total * (len(usual) + ZIPF_SHIFT))
        for i in range(len(self.pieces)):
            if model.is_byte(i):
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # pieces that go on behind a word would tie words together: then a text is one word
        self.cut = re.compile(f"{MARK}*[^{MARK}]*" if not any(MARK in p.lstrip(MARK) for p in self.pieces) else "(?s:.*)")
        self.words = {}

    def lattice(self, text):
        """Edges from each place of the marked text: (next place, ids, log-probability), and the backward log-sums."""
        return self._lattice(MARK + text.replace(" ", MARK) if text else "")

    def _lattice(self, s):
        n = len(s)
        edges, back = [None] * n, [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            node, own, j = self.trie, [], i
            while j < n:
                node = node.get(s[j])
                if node is None:
                    break
                j += 1
                end = node.get("")
                if end is not None:
                    own.append((j, (end[0],), end[1]))
            if not own or own[0][0] != i + 1:
                ids = tuple(self.bytes[b] for b in s[i].encode("utf-8", "replace"))
                own.append((i + 1, ids, self.rare * len(ids)))
            top = max(p + back[j] for j, _, p in own)
            total = top + math.log(sum(math.exp(p + back[j] - top) for j, _, p in own))
            edges[i], back[i] = own, total
        return edges, back

    def _word(self, word):
        """Steps from each place of a word: (letters, ids, chance, its logarithm), the chances of a place sum to 1."""
        edges, back = self._lattice(word)
        out = []
        for i, own in enumerate(edges):
            steps = [(j - i, ids, p + back[j] - back[i]) for j, ids, p in own]
            out.append([(d, ids, math.exp(q), q) for d, ids, q in sorted(steps, key=lambda x: -x[2])])
        if len(self.words) >= WORDS:
            self.words.clear()
        self.words[word] = out
        return out

    def sample(self, text, key, k):
        """Up to k distinct segmentations: (ids, log-probability, Gumbel value, inclusion probability)."""
        steps = []
        for word in self.cut.findall(MARK + text.replace(" ", MARK)) if text else ():
            steps += self.words.get(word) or self._word(word)
        draw = random.Random(xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "replace"), seed=key & (1 << 64) - 1)).random
        log, exp, n = math.log, math.exp, len(steps)
        order = itertools.count()
        # open nodes: (-value, number, place, log-mass, path, steps left out); with steps left out it is a group of siblings
        heap = [(log(-log(draw() or 1e-300)), next(order), 0, 0.0, None, ())]
        best = [-heap[0][0]]  # the k + 1 largest values of open and found ones
        found, threshold = [], -math.inf
        while heap:
            g, _, at, mass, path, out = heapq.heappop(heap)
            g = -g
            while True:
                if at == n:
                    if len(found) == k:
                        threshold = g
                        heap = []
                    else:
                        found.append((path, mass, g))
                    break
                own = steps[at]
                if len(own) == 1:
                    d, ids, _, _ = own[0]
                    at, path = at + d, (ids, path)
                    continue
                # the child that has this node's value
                inside = sum(s[2] for i, s in enumerate(own) if i not in out) if out else 1.0
                u, pick = draw() * inside, -1
                for i, s in enumerate(own):
                    if i not in out:
                        pick = i
                        u -= s[2]
                        if u < 0:
                            break
                d, ids, chance, logarithm = own[pick]
                rest = inside - chance if len(own) > len(out) + 1 else 0.0
                if rest < 1e-6:  # too small a difference: summed anew
                    rest = sum(s[2] for i, s in enumerate(own) if i != pick and i not in out)
                if rest > 0:
                    location = mass + log(rest)
                    # Gumbel of the siblings' mass, truncated at g
                    value = location - log(exp(min(700.0, location - g)) - log(draw() or 1e-300))
                    if len(best) <= k or value > best[0]:
                        heapq.heappush(heap, (-value, next(order), at, mass, path, (*out, pick)))
                        heapq.heappush(best, value)
                        if len(best) > k + 1:
                            heapq.heappop(best)
                at, mass, path, out = at + d, mass + logarithm, (ids, path), ()
        result = []
        for path, mass, g in found:
            ids = []
            while path is not None:
                ids.append(path[0])
                path = path[1]
            inclusion = 1.0 if threshold == -math.inf else -math.expm1(-exp(min(700.0, mass - threshold)))
            result.append(([i for part in reversed(ids) for i in part], mass, g, inclusion))
        return result

    def decode(self, ids):
        """Text of piece ids; invalid byte runs become replacement characters."""
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


def _segmenter(path):
    """A worker's segmenter for a model file."""
    return remembered("segmenter", path, lambda: Segmenter(path))


def sampled_segmentations(rows: DataFrame, keys, k=3, path=None, seed=0) -> DataFrame:
    """Up to k rows for each text: the key columns, sample (from 1), ids, log_prob, inclusion, decoded_equal.

    Null and empty texts have the empty segmentation alone, with probability 1.
    A text with fewer than k segmentations gives all of them, each with inclusion
    1.  Rows with equal keys and texts give equal samples; null keys are keys.
    ``decoded_equal``: decoding the ids gives the text back (a text that itself
    holds the word mark comes back with spaces).
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", sample int, ids array<int>, log_prob double, inclusion double, decoded_equal boolean"
    keyed = rows.select(*keys, F.col("text").alias("_text"), F.xxhash64(*keys, F.lit(seed)).alias("_key"))

    def draw(batches):
        segmenter = _segmenter(path)
        for b in batches:
            out, at = [], []
            for i, (text, key) in enumerate(zip(b["_text"], b["_key"])):
                for r, (ids, mass, _, inclusion) in enumerate(segmenter.sample(text, int(key), k)):
                    at.append(i)
                    out.append((r + 1, ids, mass, inclusion, segmenter.decode(ids) == (text or "")))
            made = pd.DataFrame(out, columns=["sample", "ids", "log_prob", "inclusion", "decoded_equal"])
            yield pd.concat([b[list(keys)].iloc[at].reset_index(drop=True), made], axis=1)

    return keyed.mapInPandas(draw, schema)
