"""Token counts of a unigram tokenizer without its pieces: Viterbi that carries score and count.

An Aho-Corasick automaton lists the vocabulary matches that end at each character, the longest
first; dynamic programming keeps the best score and the number of pieces on that path. A later
match replaces an earlier one only if its score is strictly larger, as in the exact tokenizer,
whose paths from earlier starts come first. A character that no piece covers alone has the unknown
score, the smallest score less ten; unknown characters count as their UTF-8 bytes if the
vocabulary has byte pieces, else each run of them as one.

Spaces become the meta symbol and one is put in front. Where no piece has a meta symbol after
another character, every best path passes each such place, so a text is the sum of its parts;
parts are counted once for each distinct one, found by hash in numpy, and remembered by a task in
a bounded cache. Other vocabularies take whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents
from .text import Words, chunks, mix64, row_sums

META = "▁"
UNKNOWN_PENALTY = 10.0
MAX_PIECES = 1 << 20
CACHE = 1 << 19
_FRONT = np.uint64(0x3C6EF372FE94F82B)


class Vocabulary:
    """Pieces with their scores; whether unknown characters fall back to bytes."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        if not pieces or len(pieces) > MAX_PIECES:
            raise ValueError(f"a vocabulary has 1 to {MAX_PIECES} pieces")
        self.pieces, self.byte_fallback = pieces, byte_fallback
        self.split = not any(META in p.lstrip(META) for p, _ in pieces)
        self._automaton = None
        self._known: dict[int, int] = {}

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        """The pieces and scores of a model file, all read as unigram scores; control, unknown and byte pieces left out."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [(sp.id_to_piece(i), float(sp.get_score(i))) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return cls(plain, sum(map(sp.is_byte, ids)) == 256)

    def __getstate__(self):
        return {"pieces": self.pieces, "byte_fallback": self.byte_fallback, "split": self.split, "_automaton": None, "_known": {}}

    def _build(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, s in self.pieces:
            a.add_word(p, (len(p), s))
        a.make_automaton()
        self._automaton = a
        self._unknown = min(s for _, s in self.pieces) - UNKNOWN_PENALTY

    def count(self, text: str) -> int:
        """Number of tokens of a text whose spaces are meta symbols already."""
        if self._automaton is None:
            self._build()
        n = len(text)
        score, pieces, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self._automaton.iter(text)
        end, found = next(matches, (n, None))
        unknown, by_bytes = self._unknown, self.byte_fallback
        for e in range(n):
            best, count, run, single = None, 0, False, False
            while end == e:
                length, s = found
                s += score[e + 1 - length]
                if best is None or s > best:
                    best, count = s, pieces[e + 1 - length] + 1
                single = single or length == 1
                end, found = next(matches, (n, None))
            if not single:
                s = score[e] + unknown
                if best is None or s > best:
                    best, run = s, True
                    if by_bytes:
                        count = pieces[e] + len(text[e].encode("utf-8", "surrogatepass"))
                    else:
                        count = pieces[e] + (not open_run[e])
            score[e + 1], pieces[e + 1], open_run[e + 1] = best, count, run
        return pieces[n]

    def cached(self, key: int, text: str) -> int:
        n = self._known.get(key)
        if n is None:
            n = self.count(text)
            if len(self._known) >= CACHE:
                self._known.clear()
            self._known[key] = n
        return n


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column(1)):
                if vocab.split:
                    n = _by_parts(vocab, buf, offs)
                else:
                    data = buf.tobytes()
                    texts = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(offs[:-1], offs[1:])]
                    n = np.array([vocab.count(META + t.replace(" ", META)) if t else 0 for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n)], names=["doc_id", "n_tokens"])

    return run


def _by_parts(vocab: Vocabulary, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = buf.size
    if n == 0:
        return np.zeros(len(offs) - 1, np.int64)
    space = buf == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    front = offs[:-1][offs[1:] > offs[:-1]]
    first[front] = True
    starts = np.flatnonzero(first)
    ends = np.concatenate([starts[1:], [n]])
    keys = Words(buf, offs, starts, ends, offs).hashes(lower=False)
    at = np.searchsorted(starts, front)
    keys[at] = mix64(keys[at] ^ _FRONT)
    distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
    fronts = np.zeros(starts.size, bool)
    fronts[at] = True
    data = buf.tobytes()
    counts = np.empty(distinct.size, np.int64)
    known = vocab._known
    for i, (key, a, b, f) in enumerate(zip(distinct.tolist(), starts[where].tolist(), ends[where].tolist(), fronts[where].tolist())):
        c = known.get(key)
        if c is None:
            text = data[a:b].decode("utf-8", "surrogatepass").replace(" ", META)
            c = vocab.cached(key, META + text if f else text)
        counts[i] = c
    return row_sums(counts[back], np.searchsorted(starts, offs))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Number of tokens of every whole text under a unigram vocabulary.

    One row per input row of ``docs`` (``doc_id`` and ``text``; other columns are ignored):
    ``doc_id``, ``n_tokens``. Null and empty texts have 0 tokens; repeated rows count alike. Ties
    between paths go to the path whose last piece starts earlier. The vocabulary, a million pieces
    at most, is broadcast; a text of n characters takes memory in proportion to n.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count(shared), "doc_id long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str, model: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return count_tokens(read_documents(spark, sf_dir), Vocabulary.from_sentencepiece(model))
