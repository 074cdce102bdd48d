"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word, and
dynamic programming carries the best score and its piece count: no lattice and
no pieces are kept.  The rules are those of the unigram model of the
`tokenizers` library: text is cut at spaces, each word gets the space mark in
front, a character that no one-character piece covers costs the lowest score
less 10 and runs of such characters are one piece, a later path replaces an
earlier one only if its score is higher, and paths are tried from the leftmost
start.

The words of an Arrow batch are split and numbered by Arrow, and only distinct
ones are counted: one run of the automaton over all of them, then a step of the
dynamic programming for each place in a word, for all words at once.  Counts
are kept per distinct word in a bounded table in each worker.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
UNKNOWN_COST = 10.0
LOWEST = float("-inf")
GAP = "\0"
#: Distinct words whose counts a worker keeps; the longest word kept and counted along with others; words counted at once.
KEPT_WORDS, KEPT_LENGTH, AT_ONCE = 500_000, 64, 20_000


def read_vocabulary(model: str | bytes) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece model file, in its order.

    The file's fields are read directly: field 1 of the model is a piece, whose
    fields 1, 2 and 3 are its text, score and type (1 or absent: ordinary).
    """
    import struct

    data = model if isinstance(model, bytes) else open(model, "rb").read()

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        while at < end:
            tag, at = number(at)
            kind = tag & 7
            value = 0
            start = at
            if kind == 0:
                value, at = number(at)
            elif kind == 1:
                at += 8
            elif kind == 2:
                value, at = number(at)
                start, at = at, at + value
            else:
                at += 4
            yield tag >> 3, start, at, value

    pieces = []
    for field, start, end, _ in fields(0, len(data)):
        if field == 1:
            text, score, kind = "", 0.0, 1
            for part, s, e, value in fields(start, end):
                if part == 1:
                    text = data[s:e].decode()
                elif part == 2:
                    score = struct.unpack("<f", data[s:e])[0]
                elif part == 3:
                    kind = value
            if kind == 1:
                pieces.append((text, score))
    return pieces


class Counter:
    """Counts the pieces of texts."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.single = np.full(sys.maxunicode + 1, LOWEST)  # scores of one-character pieces, by code point
        for k, (piece, score) in enumerate(vocabulary):
            if len(piece) == 1:
                self.single[ord(piece)] = score
            else:
                self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.length = np.array([len(piece) for piece, _ in vocabulary])
        self.score = np.array([score for _, score in vocabulary])
        self.unknown = float(self.score.min()) - UNKNOWN_COST
        self.known: dict[str, int] = {}

    def ends(self, word: str) -> list[int]:
        """Where each piece of one word ends, space mark included."""
        n = len(word)
        best, back, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done, top, start_of_top = 0, LOWEST, 0

        def close(end: int) -> None:
            """Ends a position: the one-character piece comes last, or the unknown character if there is none."""
            best[end], back[end] = top, start_of_top
            own = float(self.single[ord(word[end - 1])])
            value = best[end - 1] + (self.unknown if own == LOWEST else own)
            if value > top:
                best[end], back[end], odd[end] = value, end - 1, own == LOWEST
                if odd[end] and odd[end - 1]:
                    back[end] = back[end - 1]

        # the automaton gives the matches by their end, and of one end the longest first
        for last, k in self.automaton.iter(word):
            while done < last:
                done += 1
                close(done)
                top = LOWEST
            length = int(self.length[k])
            value = best[last + 1 - length] + float(self.score[k])
            if value > top:
                top, start_of_top = value, last + 1 - length
        while done < n:
            done += 1
            close(done)
            top = LOWEST
        out = []
        while n:
            out.append(n)
            n = back[n]
        return out[::-1]

    def many(self, words: list[str]) -> np.ndarray:
        """Pieces of each of many short words, space mark included: positions of equal place in all words at once."""
        order = np.argsort([-len(w) for w in words], kind="stable")
        text = GAP.join([words[k] for k in order])
        sizes = np.array([len(words[k]) for k in order])
        starts = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        row = np.searchsorted(starts, found[:, 0], side="right") - 1
        place = found[:, 0] + 1 - starts[row]
        by_place = np.argsort(place, kind="stable")  # of one place by word, of one word the longest first
        row, ends, piece = row[by_place], found[by_place, 0] + 1, found[by_place, 1]
        cut = np.searchsorted(place[by_place], np.arange(1, sizes[0] + 2))
        own = self.single[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        last = np.where(own == LOWEST, self.unknown, own)
        best, count, odd = np.zeros(len(text) + 1), np.zeros(len(text) + 1, dtype=np.int64), np.zeros(len(text) + 1, dtype=bool)
        for j in range(1, sizes[0] + 1):
            m = np.searchsorted(-sizes, -j, side="right")  # words of j characters at least
            at = starts[:m] + j
            top, pieces = np.full(m, LOWEST), np.zeros(m, dtype=np.int64)
            some = slice(cut[j - 1], cut[j])
            rows = row[some]
            if len(rows):
                begin = ends[some] - self.length[piece[some]]
                value = best[begin] + self.score[piece[some]]
                groups = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                high = np.maximum.reduceat(value, groups)
                first = np.flatnonzero(value == np.repeat(high, np.diff(np.append(groups, len(rows)))))
                first = first[np.append(True, rows[first][1:] != rows[first][:-1])]
                top[rows[groups]], pieces[rows[groups]] = high, count[begin[first]] + 1
            other = best[at - 1] + last[at - 1]
            takes = other > top  # the one-character piece or the unknown character comes last
            odd[at] = takes & (own[at - 1] == LOWEST)
            best[at] = np.where(takes, other, top)
            count[at] = np.where(takes, count[at - 1] + ~(odd[at - 1] & odd[at]), pieces)
        out = np.empty(len(words), dtype=np.int64)
        out[order] = count[starts + sizes]
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Pieces of each of distinct words, with the space mark put in front."""
        known = self.known
        out = np.fromiter((known.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(out < 0)
        long = [k for k in new.tolist() if len(words[k]) >= KEPT_LENGTH or GAP in words[k]]
        for k in long:
            out[k] = len(self.ends(MARK + words[k]))
        new = np.setdiff1d(new, long)
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            out[part] = self.many([MARK + words[k] for k in part.tolist()])
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
        known.update((words[k], int(out[k])) for k in new[:KEPT_WORDS].tolist())
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of each text (none null), and of its words: counts of all words in order, and where each text's begin.

        Words are what single spaces separate; a text's own first space is the
        mark, so the empty word in front of it has no piece, nor has an empty text.
        """
        texts = pc.replace_substring(texts.cast(pa.large_string()), MARK, " ")
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        per_word = self.words(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int64)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py() if len(texts) else np.zeros(1, dtype=np.int64)
        bare = pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        per_word[offsets[:-1][bare]] = 0
        total = np.concatenate(([0], np.cumsum(per_word)))
        return total[offsets[1:]] - total[offsets[:-1]], per_word, offsets


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count of every whole text.

    model is a vocabulary file readable by the driver, which reads it once and
    ships its pieces.  Returns id, n_chars (code points) and n_tokens.  Null
    and empty texts count 0; very long texts and words are read whole, in time
    linear in their length; of paths of equal score the library's own choice
    counts; repeated rows give repeated rows; null ids stay; other columns are
    not read; an empty table gives an empty table.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shipped.value)
        for whole in batches:
            for batch in slices(whole):
                n, _, _ = counter.batch(batch["text"])
                yield pa.RecordBatch.from_arrays([batch["id"], pc.utf8_length(batch["text"]).cast(pa.int64()), pa.array(n)], ["id", "n_chars", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInArrow(rows, f"id {kind}, n_chars long, n_tokens long").withColumnRenamed("id", id_col)
