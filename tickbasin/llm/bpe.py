"""Byte-level BPE encoding and decoding, long unsplit text by tree concatenation.

Vocabulary, merges and special tokens come from a `tokenizers` file; the results
are those of that library.  A batch of texts is cut where white space follows
other text, as no token crosses such a place, Arrow numbers the distinct pieces,
and only those that a worker has not met before are split by the file's pattern
and merged: all of them side by side, one merge of each word in a step.

A word longer than a leaf is cut into halves of halves.  All leaves of a batch
are encoded at once, and then the levels of the trees are joined from the
bottom, all joins of a level at once: the tokens on both sides of a join are
encoded anew, from two on each side, and twice as many until the first and the
last token come out as they were.  The neighbours of every token are then those
of a right encoding, and a sequence whose neighbours all are so is the encoding
of the whole, so a join is exact and mostly costs a few bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, release_memory

#: Bytes of a leaf; words up to it are merged directly.
LEAF = 32
#: Tokens on each side of a join that are encoded anew at first.
WINDOW = 2
#: Pieces that a worker keeps with their tokens, and the longest of them; bytes of text taken at once.
KEPT_PIECES, KEPT_BYTES, AT_ONCE = 700_000, 48, 4 << 20
#: The rank of no merge.
NONE = np.iinfo(np.int32).max

# The pattern of byte-level pre-tokenization, for texts whose characters stand for their classes.
PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
ASCII_PATTERN = re.compile(PATTERN.pattern.encode(), re.ASCII)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# The last bytes of other white space and those before them; where both stand a text is not cut.
SPACE_END, SPACE_BEFORE = (np.isin(np.arange(256), x) for x in ([*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], [0x80, 0x81, 0x9A, 0xC2]))


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a vocabulary entry stands for: printable Latin-1 itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@dataclass
class Vocabulary:
    """What a `tokenizers` file of a byte-level BPE holds."""

    tokens: list[bytes]  # by id
    byte_ids: np.ndarray  # id of each byte
    pairs: np.ndarray  # keys of the merges, sorted
    ranks: np.ndarray  # their ranks
    made: np.ndarray  # the id that a rank makes
    special: dict[str, int]
    pre_tokenizer: str  # for the classes of characters


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a file; other kinds of models, normalizers and special tokens are refused."""
    file = json.load(open(path, encoding="utf-8"))
    model, split = file["model"], file["pre_tokenizer"] or {}
    added = file["added_tokens"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token"))
    if not plain or file["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or (file["decoder"] or {}).get("type") != "ByteLevel":
        raise ValueError("not a byte-level BPE without normalizer")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("special tokens must be plain texts")
    of_character, ids = byte_of_character(), model["vocab"]

    def spelled(entry: str) -> bytes:
        return bytes(of_character[c] for c in entry) if all(c in of_character for c in entry) else entry.encode()

    special = {t["content"]: t["id"] for t in added}
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for entry, k in ids.items():
        tokens[k] = spelled(entry)
    for entry, k in special.items():
        tokens[k] = spelled(entry)
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([ids[a] * len(tokens) + ids[b] for a, b in merges], dtype=np.int64)
    order = np.argsort(keys)
    by_byte = {b: c for c, b in of_character.items()}
    byte_ids = np.array([ids[by_byte[b]] for b in range(256)], dtype=np.int32)
    return Vocabulary(tokens, byte_ids, keys[order], order.astype(np.int32), np.array([ids[a + b] for a, b in merges], dtype=np.int32), special, json.dumps(split))


class Classes(dict):
    """Stand-ins of characters for the pattern: x a letter, 1 a digit, tab white space, ! another one.

    Each character that is not ASCII is asked of the library once, so that both
    follow the same version of Unicode.
    """

    def __init__(self, pre_tokenizer: str):
        from tokenizers import Tokenizer, models

        holder = Tokenizer(models.BPE())
        state = json.loads(holder.to_str())
        state["pre_tokenizer"] = json.loads(pre_tokenizer)
        self.split = Tokenizer.from_str(json.dumps(state)).pre_tokenizer.pre_tokenize_str

    def __missing__(self, code: int) -> int:
        character = chr(code)
        if code < 128:
            found = code
        else:
            found = ord(next((stand_in for lead, stand_in in (("a", "x"), ("1", "1"), ("!", "!")) if len(self.split(lead + character)) == 1), "\t"))
        self[code] = found
        return found


class Encoder:
    """Encodes texts; keeps the tokens of short pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.classes = Classes(vocabulary.pre_tokenizer)
        self.special = {text.encode(): k for text, k in vocabulary.special.items()}
        self.special_pattern = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.forget()

    def forget(self) -> None:
        """Empties the table of pieces."""
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.used = self.held = 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of neighbours."""
        keys = left.astype(np.int64) * len(self.v.tokens) + right
        at = np.minimum(np.searchsorted(self.v.pairs, keys), len(self.v.pairs) - 1)
        return np.where(self.v.pairs[at] == keys, self.v.ranks[at], NONE)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and how many each has: in a step every word's merge of least rank, from the left."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        done_ids, done_words = [], []
        ids = self.v.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        inner = np.append(word[1:] == word[:-1], False) if len(word) else np.zeros(0, dtype=bool)
        rank = np.full(len(ids), NONE, dtype=np.int32)
        at = np.flatnonzero(inner)
        rank[at] = self.rank(ids[at], ids[at + 1]) if len(at) else rank[at]
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(ids)))
            if (low == NONE).any():  # finished words leave
                stays = np.repeat(low != NONE, length)
                done_ids.append(ids[~stays])
                done_words.append(word[~stays])
                ids, word, rank = ids[stays], word[stays], rank[stays]
                low, length = low[low != NONE], length[low != NONE]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            # of overlapping pairs, as in aaa, every other one from the left
            run = np.flatnonzero(np.append(True, np.diff(hit) != 1))
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            ids[hit] = self.v.made[rank[hit]]
            stays = np.ones(len(ids), dtype=bool)
            stays[hit + 1] = False
            new = hit - np.arange(len(hit))
            ids, word, rank = ids[stays], word[stays], rank[stays]
            near = np.concatenate((new, new[new > 0] - 1))
            last = near + 1 >= len(ids)
            right = np.where(last, near, near + 1)
            rank[near] = np.where(last | (word[near] != word[right]), NONE, self.rank(ids[near], ids[right]))
        if not done_ids:
            return np.zeros(0, dtype=np.int32), sizes
        all_ids, all_words = np.concatenate(done_ids), np.concatenate(done_words)
        return all_ids[np.argsort(all_words, kind="stable")], np.bincount(all_words, minlength=len(words))

    def arrays(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens of each word."""
        ids, sizes = self.merged(words)
        return np.split(ids, np.cumsum(sizes)[:-1]) if words else []

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens."""
        return b"".join(map(self.v.tokens.__getitem__, ids.tolist()))

    def joined(self, lefts: list[np.ndarray], rights: list[np.ndarray]) -> list[np.ndarray]:
        """Joins encodings of neighbouring halves, all at once, with windows that grow until both ends agree."""
        out: list = [None] * len(lefts)
        open_, reach = list(range(len(lefts))), WINDOW
        while open_:
            cuts = [(max(0, len(lefts[i]) - reach), min(reach, len(rights[i]))) for i in open_]
            windows = self.arrays([self.spelled(lefts[i][a:]) + self.spelled(rights[i][:b]) for i, (a, b) in zip(open_, cuts, strict=True)])
            again = []
            for i, (a, b), window in zip(open_, cuts, windows, strict=True):
                left, right = lefts[i], rights[i]
                if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                    out[i] = np.concatenate((left[:a], window, right[b:]))
                else:
                    again.append(i)
            open_, reach = again, 2 * reach
        return out

    def trees(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens of long words: leaves first, then the joins of each level of all trees."""
        parts, counts = [], []
        for w in words:
            n = 1
            while len(w) > n * LEAF:
                n *= 2
            ends = [len(w) * k // n for k in range(n + 1)]
            parts += [w[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            counts.append(n)
        nodes = self.arrays(parts)
        done: list = [None] * len(words)
        owners = np.repeat(np.arange(len(words)), counts).tolist()
        while nodes:
            # a tree's leaves are a power of two, so its nodes pair up until one is left
            single = [k == 0 or owners[k] != owners[k - 1] for k in range(len(owners))]
            single = [s and (k + 1 == len(owners) or owners[k + 1] != owners[k]) for k, s in enumerate(single)]
            for k, alone in enumerate(single):
                if alone:
                    done[owners[k]] = nodes[k]
            rest = [k for k, alone in enumerate(single) if not alone]
            nodes, owners = self.joined([nodes[k] for k in rest[::2]], [nodes[k] for k in rest[1::2]]), [owners[k] for k in rest[::2]]
        return done

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all distinct words in their order, and how many each has."""
        long = [k for k, w in enumerate(words) if len(w) > LEAF]
        if not long:
            return self.merged(words)
        ids, sizes = self.merged([w if len(w) <= LEAF else b"" for w in words])
        trees = self.trees([words[k] for k in long])
        at = np.repeat((np.cumsum(sizes) - sizes)[long], [len(t) for t in trees])
        sizes[long] = [len(t) for t in trees]
        return np.insert(ids, at, np.concatenate(trees)), sizes

    def split(self, piece: bytes) -> list[bytes]:
        """The words of a piece of text; a special token's text has none."""
        if piece in self.special:
            return []
        if piece.isascii():
            return ASCII_PATTERN.findall(piece)
        text = piece.decode("utf-8", "surrogatepass")
        return [text[m.start() : m.end()].encode("utf-8", "surrogatepass") for m in PATTERN.finditer(text.translate(self.classes))]

    def slots(self, pieces: list[bytes]) -> np.ndarray:
        """Places in the table of each distinct piece, which learns new ones."""
        if len(self.known) + len(pieces) > KEPT_PIECES:
            self.forget()
        out = np.array([*map(self.known.get, pieces, repeat(-1))], dtype=np.int64)
        new = np.flatnonzero(out < 0).tolist()
        if not new:
            return out
        fresh_pieces = [pieces[k] for k in new]
        lists = [*map(self.split, fresh_pieces)]
        numbers: dict[bytes, int] = {}
        listed = np.array([numbers.setdefault(w, len(numbers)) for ws in lists for w in ws], dtype=np.int64)
        ids, sizes = self.words([*numbers])
        ids, per_word = ragged(ids, np.cumsum(sizes) - sizes, sizes, listed)
        count = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        total = np.concatenate(([0], np.cumsum(per_word)))
        ends = np.cumsum(count)
        sizes = total[ends] - total[ends - count]
        bare = np.flatnonzero(count == 0)  # special tokens
        ids = np.insert(ids, total[ends[bare]], [self.special[fresh_pieces[k]] for k in bare.tolist()]).astype(np.int32)
        sizes[bare] = 1
        places = np.arange(len(new)) + self.used
        self.flat = _grown(self.flat, self.held, ids)
        self.starts = _grown(self.starts, self.used, self.held + np.cumsum(sizes) - sizes)
        self.sizes = _grown(self.sizes, self.used, sizes)
        self.used, self.held = self.used + len(new), self.held + len(ids)
        out[new] = places
        self.known.update((p, s) for p, s in zip(fresh_pieces, places.tolist(), strict=True) if len(p) <= KEPT_BYTES)
        return out

    def batch(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in order, and where each text's begin and end."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base, end = int(offsets[0]), int(offsets[-1])
        if base == end:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[base:end]
        space = SPACE[data]
        cuts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        wide = SPACE_END[data[cuts - 1]] & (cuts > 1) & SPACE_BEFORE[data[np.maximum(cuts - 2, 0)]]
        found = [cuts[~wide], offsets - base]
        if self.special:
            for text in self.special:
                for k in np.flatnonzero(pc.match_substring(texts, text.decode()).to_numpy(zero_copy_only=False)).tolist():
                    at = int(offsets[k]) - base
                    found.append(np.array([at + x for m in self.special_pattern.finditer(data[at : int(offsets[k + 1]) - base].tobytes()) for x in m.span()], dtype=np.int64))
        is_cut = np.zeros(end - base + 1, dtype=bool)
        for places in found:
            is_cut[places] = True
        cuts = np.flatnonzero(is_cut)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        slots = self.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, sizes = ragged(self.flat, self.starts, self.sizes, slots)
        total = np.concatenate(([0], np.cumsum(sizes)))
        if self.used > 2 * KEPT_PIECES or self.held > 16 * KEPT_PIECES:  # many long pieces, which are not kept
            self.forget()
        return ids, total[np.searchsorted(cuts, offsets - base)]


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted lists of a flat store, one after the other, and their sizes."""
    n = sizes[wanted]
    at = np.repeat(starts[wanted] - (np.cumsum(n) - n), n)
    return flat[at + np.arange(len(at))], n


def _grown(store: np.ndarray, used: int, values: np.ndarray) -> np.ndarray:
    """The store with the values behind its used part."""
    if used + len(values) > len(store):
        store = np.concatenate((store[:used], np.zeros(max(len(store), len(values)), dtype=store.dtype)))
    store[used : used + len(values)] = values
    return store


def by_bytes(batch: pa.RecordBatch, column: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes in the column, or of one row."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def shipped(spark: SparkSession, path: str):
    """A vocabulary's fields for the workers, which have no class of it before they unpickle theirs: a few MB, by the file's own size."""
    return spark.sparkContext.broadcast(vars(read_vocabulary(path)))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text by the `tokenizers` file at path, which the driver reads once.

    Returns id, n_tokens and ids: the ids as little-endian unsigned 32-bit
    integers in a binary column.  Special tokens' texts are those tokens, as in
    the library, and none is added.  Null and empty texts have no tokens; very
    long texts and words are encoded whole; ties cannot occur, since every merge
    has a rank of its own and equal pairs merge from the left; repeated rows
    give repeated rows; null ids stay; other columns, whatever their names, are
    not read; an empty table gives an empty table.
    """
    vocabulary = shipped(docs.sparkSession, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**vocabulary.value))
        for whole in batches:
            for batch in by_bytes(whole, 1):
                ids, at = encoder.batch(batch.column(1).cast(pa.large_string()))
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(at * 4), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), packed.cast(pa.binary())], ["id", "n_tokens", "ids"])
            release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(rows, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text", skip_special: bool = False) -> DataFrame:
    """The table with its column of packed ids replaced by their text.

    Ids that the vocabulary lacks are passed over, and bytes that are no UTF-8
    become replacement characters, both as in the library; null ids give a null
    text, no ids an empty one.  The other columns stay; if one has the text
    column's name, the new one gets underscores.
    """
    vocabulary = shipped(encoded.sparkSession, path)
    rest = [c for c in encoded.columns if c != ids_col]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.value["tokens"]
        special = set(vocabulary.value["special"].values()) if skip_special else set()

        def text(packed: bytes | None) -> str | None:
            if packed is None:
                return None
            ids = np.frombuffer(packed, dtype="<u4")
            if special or (len(ids) and int(ids.max()) >= len(tokens)):
                return b"".join(tokens[k] for k in ids.tolist() if k < len(tokens) and k not in special).decode("utf-8", "replace")
            return b"".join(map(tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")

        for whole in batches:
            for batch in by_bytes(whole, len(rest)):
                texts = pa.array([text(x) for x in batch.column(len(rest)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], "text"])
            release_memory()

    read = encoded.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)], F.col(f"`{ids_col}`").alias("ids"))
    schema = ", ".join([f"c{k} {read.schema[k].dataType.simpleString()}" for k in range(len(rest))] + ["text string"])
    name = fresh(encoded.select(*[F.col(f"`{c}`") for c in rest]), text_col)
    return read.mapInArrow(rows, schema).toDF(*rest, name)
