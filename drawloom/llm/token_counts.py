"""Token counts under a unigram model, by dynamic programming shared over a trie.

Texts are cut at white space into pre-tokens.  The distinct new pre-tokens of a
batch are sorted, which lays out their trie: a node is a row's prefix that the
row before does not share.  Forward scores are worked out once per node, level
by level over all nodes at once, and the token count of a pre-token is stored
at its terminal node.  Memory is bounded by the batch and a cache of counts;
nothing is shuffled.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_spans, mix, text_chunks, word_bounds

SPACE = "▁"
#: Characters of a pre-token that the trie's matrix covers.
LONG = 40
CACHE = 1_000_000


class UnigramVocabulary:
    """Pieces of a public vocabulary with log probabilities by Zipf's law over their ranks.

    The file holds ranks, not probabilities, so a piece of rank r weighs
    1 / (r + 1) of all.  A character that no piece covers falls back to its
    UTF-8 bytes, each a token of the least score.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        total = np.log(np.sum(1 / np.arange(1, len(names) + 1)))
        self.scores = {p: float(-np.log(i + 1) - total) for i, p in enumerate(names)}
        self.byte = float(-np.log(len(names) + 1) - total)
        self.longest = max(map(len, names))
        order = sorted((_hash(p), s) for p, s in self.scores.items())
        self.keys = np.array([k for k, _ in order], np.uint64)
        self.values = np.array([s for _, s in order])

    def count(self, word: str) -> int:
        """Tokens of one pre-token, by the plain recurrence."""
        return self._extend(word, 0, [0.0], [0])

    def _extend(self, word: str, begin: int, best, n) -> int:
        """Tokens of ``word``, from the scores and counts of its prefixes of up to ``begin`` characters (the last ones do)."""
        best, n = deque(best, self.longest), deque(n, self.longest)
        for end in range(begin + 1, len(word) + 1):
            top = None
            for k in range(1, min(end, self.longest) + 1):
                s = self.scores.get(word[end - k : end])
                if s is not None and (top is None or best[-k] + s > top[0]):
                    top = best[-k] + s, n[-k] + 1
            if top is None or word[end - 1] not in self.scores:
                size = len(word[end - 1].encode("utf-8", "replace"))
                other = best[-1] + size * self.byte, n[-1] + size
                top = other if top is None or other[0] > top[0] else top
            best.append(top[0])
            n.append(top[1])
        return n[-1]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each of many distinct pre-tokens, over their common trie.

        Below LONG characters the trie is a matrix of nodes; what a longer word
        has beyond them is a branch of its own, worked out from its node there.
        """
        out = np.zeros(len(words), np.int64)
        order = [i for i in sorted(range(len(words)), key=words.__getitem__) if words[i]]
        if not order:
            return out
        heads = [words[i][:LONG] for i in order]
        size = np.array([len(h) for h in heads])
        width = int(size.max())
        codes = np.zeros((len(order), width), np.uint32)  # 0 is no character
        codes[np.arange(width) < size[:, None]] = np.frombuffer("".join(heads).encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        same = np.zeros(codes.shape, bool)
        same[1:] = np.logical_and.accumulate(codes[1:] == codes[:-1], axis=1)
        prefix = np.zeros((len(order), width + 1), np.uint64)
        np.cumsum(codes.astype(np.uint64) * _POWER[:width], axis=1, out=prefix[:, 1:])
        best, n = np.zeros((width + 1, len(order))), np.zeros((width + 1, len(order)), np.int64)
        owner = np.zeros((width + 1, len(order)), np.int64)
        rows = np.arange(len(order))
        for end in range(1, width + 1):
            alive = size >= end
            new = np.flatnonzero(alive & ~same[:, end - 1])
            mark = np.zeros(len(order), np.int64)
            mark[new] = new
            owner[end] = np.where(alive, np.maximum.accumulate(mark), rows)
            top, count = np.full(len(new), -np.inf), np.zeros(len(new), np.int64)
            known = np.zeros(len(new), bool)
            for k in range(1, min(end, self.longest) + 1):
                start = end - k
                key = _finish((prefix[new, end] - prefix[new, start]) * _INVERSE[start], k)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                if k == 1:
                    known = hit
                from_ = owner[start, new]
                score = np.where(hit, best[start, from_] + self.values[at], -np.inf)
                better = score > top
                top = np.where(better, score, top)
                count = np.where(better, n[start, from_] + 1, count)
            if not known.all():
                code = codes[new, end - 1] - 1
                size_ = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
                from_ = owner[end - 1, new]
                score = np.where(known, -np.inf, best[end - 1, from_] + size_ * self.byte)
                better = score > top
                top = np.where(better, score, top)
                count = np.where(better, n[end - 1, from_] + size_, count)
            best[end, new], n[end, new] = top, count
        out[order] = n[size, owner[size, rows]]
        for r, i in enumerate(order):
            if len(words[i]) > LONG:
                at = np.arange(max(0, LONG + 1 - self.longest), LONG + 1)
                out[i] = self._extend(words[i], LONG, best[at, owner[at, r]].tolist(), n[at, owner[at, r]].tolist())
        return out


_ODD = 0x9E3779B97F4A7C15
_POWER = np.array([pow(_ODD, i, 1 << 64) for i in range(LONG + 2)], np.uint64)
_INVERSE = np.array([pow(_ODD, -i, 1 << 64) for i in range(LONG + 2)], np.uint64)


def _finish(x: np.ndarray, k: int) -> np.ndarray:
    return mix(x + np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64)))


def _hash(piece: str) -> int:
    x = sum((ord(c) + 1) * pow(_ODD, i, 1 << 64) for i, c in enumerate(piece)) % (1 << 64)
    return int(_finish(np.array([x], np.uint64), len(piece))[0])


_LOADED: dict[str, tuple[UnigramVocabulary, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_pretokens, n_tokens over its whole text.

    Pre-tokens are runs of anything but the ASCII white-space characters, each
    scored with the word mark in front.  Ties between segmentations go to the
    one whose last piece is shorter.  Null, empty and blank texts count 0;
    repeated rows come back each; no rows give no rows.
    """

    def run(batches):
        if vocabulary_path not in _LOADED:
            _LOADED[vocabulary_path] = UnigramVocabulary(vocabulary_path), {}
        vocab, cache = _LOADED[vocabulary_path]
        for batch in batches:
            words, tokens = [], []
            for _, data, offsets in text_chunks(batch.column(1)):
                starts, ends, first = word_bounds(data, offsets)
                keys, place = distinct_spans(data, starts, ends)
                missing = [w for w in keys if w not in cache]
                found = vocab.counts([SPACE + w.decode("utf-8", "replace") for w in missing])
                if len(cache) + len(missing) > CACHE:
                    have = {w: cache[w] for w in keys if w in cache}
                    cache.clear()
                    cache.update(have)
                cache.update(zip(missing, found.tolist(), strict=True))
                total = np.concatenate([[0], np.cumsum(np.array([cache[w] for w in keys], np.int64)[place])]) if keys else np.zeros(1, np.int64)
                words.append(np.diff(first))
                tokens.append(np.diff(total[first]))
            if words:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words).astype(np.int64)), pa.array(np.concatenate(tokens))], [id_col, "n_pretokens", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, n_pretokens long, n_tokens long")
