"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie of word beginnings and of continuations.  A node whose
next letter fails does not start over: its failure link leads to the node that
is reached after the longest pieces of what was read so far are split off, and
the number of those pieces is stored with it.  Reading a word therefore takes
steps in proportion to its length and gives the number of pieces of greedy
longest-match splitting, while no piece is ever built.
"""

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import remembered

WORDS = 400_000  # words remembered by a task; beyond, the memory starts anew
START = "▁"


class LongestMatch:
    """Automaton over whole pieces: ``begin`` start a word, ``inner`` continue one."""

    def __init__(self, begin, inner):
        self.child, self.piece, self.depth = [{}, {}], [False, False], [0, 0]
        for root, pieces in ((0, begin), (1, inner)):
            for p in pieces:
                if p:
                    self._add(root, p)
        self._link()
        self.memory = {}

    def _add(self, node, piece):
        for c in piece:
            nxt = self.child[node].get(c)
            if nxt is None:
                nxt = self.child[node][c] = len(self.child)
                self.child.append({}), self.piece.append(False), self.depth.append(self.depth[node] + 1)
            node = nxt
        self.piece[node] = True

    def _link(self):
        """Failure links and popped-piece counts, in order of depth."""
        self.fail, self.pops = [-1] * len(self.child), [0] * len(self.child)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.child[u].items():
                    below.append(v)
                    if self.piece[v]:  # all that was read is one piece
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    n, z = self.pops[u], self.fail[u]
                    while z >= 0 and c not in self.child[z]:
                        n, z = n + self.pops[z], self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.child[z][c], n
            level = below

    def count(self, word):
        """(pieces, unknown): a word that greedy splitting cannot finish is one unknown piece."""
        child, fail, pops = self.child, self.fail, self.pops
        u, n = 0, 0
        for c in word:
            while True:
                v = child[u].get(c)
                if v is not None:
                    u = v
                    break
                if fail[u] < 0:
                    return 1, 1
                n += pops[u]
                u = fail[u]
        while u != 1:
            if fail[u] < 0:
                return 1, 1
            n += pops[u]
            u = fail[u]
        return n, 0

    def lookup(self, word):
        got = self.count(word)
        if len(word) <= 40:
            if len(self.memory) >= WORDS:
                self.memory.clear()
            self.memory[word] = got
        return got

    def text(self, text):
        """(words, pieces, unknown words) of a whole text."""
        words, pieces, unknown, memory = (text or "").translate(_SPACES).split(" "), 0, 0, self.memory
        n = 0
        for w in words:
            if w:
                got = memory.get(w)
                if got is None:
                    got = self.lookup(w)
                n += 1
                pieces += got[0]
                unknown += got[1]
        return n, pieces, unknown


_SPACES = {i: " " for i in range(9, 14)}


def vocabulary(path=None):
    """Word beginnings and continuations of a sentencepiece model file (its pieces with and without the word mark)."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    begin = [p[len(START):] for p in pieces if p.startswith(START) and START not in p[1:]]
    return begin, [p for p in pieces if START not in p]


def _automaton(path):
    """A worker's automaton for a vocabulary file."""
    return remembered("wordpieces", path, lambda: LongestMatch(*vocabulary(path)))


def token_counts(docs: DataFrame, path=None) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown.

    Words are runs of anything but ASCII white space; a word begins with a
    beginning piece and goes on with continuations, each as long as possible.  A
    word that this cannot finish counts as one unknown token.  Null and empty
    texts have none; repeated rows get equal counts; words of any length take
    time in proportion.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def count(batches):
        automaton = _automaton(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), **dict(zip(("n_words", "n_tokens", "n_unknown"), zip(*map(automaton.text, b.text))))}) if len(b) else pd.DataFrame(columns=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(count, "doc_id long, n_words long, n_tokens long, n_unknown long")
