"""Best-fit packing into sequences of several permitted lengths.

Texts are measured in tokens by the exact counter of tokens.py, and a text of
more tokens than the largest length is cut into pieces between words (a word
of more tokens than that at its own tokens' ends), so no token is lost.  Each
task packs the rows that it reads, in shards of a bounded number of pieces and
bytes, and writes the pieces with their texts in the order of the sequences:
one pass, no shuffle.  A shard is packed longest piece first: every permitted
length is filled with what is left in the shard, always with the longest piece
that fits, and the one of the least cost for each token that it holds is opened
and keeps these pieces.  So a bin's room is left over only where nothing fits.
In the end every bin shrinks to the smallest length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, slices
from .tokens import MARK, Counter, read_vocabulary

#: Permitted sequence lengths in tokens.
SIZES = (512, 1024, 2048, 4096)
#: Pieces packed together at most, and the bytes of text at which a shard is closed.
SHARD, SHARD_BYTES = 20_000, 8 << 20


def cost(size: int) -> float:
    """Cost of a sequence: linear layers, attention (quadratic), and a fixed share for each sequence."""
    return size + size * size / 32768 + 24


def filled(size: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """What a new bin of a size takes: the longest piece left, then always the longest left that fits; pieces by length."""
    used: dict[int, int] = {}
    room, at = size, len(lengths) - 1
    while at >= 0:
        length = lengths[at]
        n = min(room // length, counts[length]) if length else counts[0]
        if n:
            used[length] = n
            room -= n * length
        at = min(at, bisect_right(lengths, room)) - 1
    return used


def bins_of(counts: dict[int, int], sizes: tuple[int, ...]) -> list[tuple[dict[int, int], int]]:
    """Bins as (pieces by length, how many such bins), for pieces by length.

    Every permitted size that holds the longest piece left is filled with what
    is left, and the one of the least cost for each token is opened, with its
    pieces, as often as they last.
    """
    counts, left = dict(counts), sorted(counts)
    out = []
    while left:
        best = None
        for size in sizes[bisect_left(sizes, left[-1]) :]:
            used = filled(size, left, counts)
            held = sum(length * n for length, n in used.items())
            price = cost(sizes[bisect_left(sizes, held)]) / max(1, held)
            if best is None or price < best[0]:
                best = price, used
        used = best[1]
        times = min(counts[length] // n for length, n in used.items())
        out.append((used, times))
        for length, n in used.items():
            counts[length] -= n * times
            if not counts[length]:
                del left[bisect_left(left, length)]
    return out


def price_of(plan: list[tuple[dict[int, int], int]], sizes: tuple[int, ...]) -> float:
    """Cost of bins, each of the smallest size that holds its contents."""
    return sum(times * cost(sizes[bisect_left(sizes, sum(length * n for length, n in used.items()))]) for used, times in plan)


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece, and the size of every bin.

    The plan of all sizes together competes with those of each size alone, so
    it never costs more than the best of them.  Pieces are at most the largest
    size; ties keep their order.
    """
    sizes = tuple(sorted(sizes))
    pieces: dict[int, list[int]] = {}
    for i, length in enumerate(lengths):
        pieces.setdefault(length, []).append(i)
    counts = {length: len(of) for length, of in pieces.items()}
    plans = [bins_of(counts, sizes)] + [bins_of(counts, (s,)) for s in sizes if len(sizes) > 1 and pieces and s >= max(pieces)]
    plan = min(plans, key=lambda p: price_of(p, sizes))
    bins, offsets, opened = [0] * len(lengths), [0] * len(lengths), []
    taken = dict.fromkeys(pieces, 0)
    for used, times in plan:
        held = sum(length * n for length, n in used.items())
        for _ in range(times):
            at = 0
            for length, n in used.items():
                first = taken[length]
                taken[length] = first + n
                for i in pieces[length][first : first + n]:
                    bins[i], offsets[i] = len(opened), at
                    at += length
            opened.append(sizes[bisect_left(sizes, held)])
    return bins, offsets, opened


def cut(text: str, words: np.ndarray, largest: int, counter: Counter) -> list[tuple[int, int, int]]:
    """Pieces (start, end, tokens) of a text of more tokens than the largest size; words: the tokens of its words.

    The space between two pieces is in neither: it is the mark of the next word.
    """
    out: list[tuple[int, int, int]] = []
    start = at = end = held = 0
    for word, n in zip(text.replace(MARK, " ").split(" "), words.tolist(), strict=True):
        if held + n > largest and end > start:
            out.append((start, end, held))
            start, held = at, 0
        if n > largest:  # a word that no sequence holds
            ends = [e - 1 for e in counter.ends(MARK + word)]  # the mark is no character of the text
            for k in range(largest, n, largest):
                out.append((start, at + ends[k - 1], largest))
                start = at + ends[k - 1]
            n -= (n - 1) // largest * largest
            held = 0
        end = at + len(word)
        held += n
        at = end + 1
    return [*out, (start, end, held)]


class Shards:
    """Collects pieces, and packs them whenever enough are there."""

    def __init__(self, sizes: tuple[int, ...], first_bin: int):
        self.sizes, self.bin, self.tables, self.n, self.bytes = sizes, first_bin, [], 0, 0

    def add(self, pieces: pa.Table) -> Iterator[pa.Table]:
        """Takes pieces (id, piece, start, end, n_tokens, text) and gives the packed shards."""
        while len(pieces):
            part = pieces.slice(0, SHARD - self.n)
            pieces = pieces.slice(len(part))
            self.tables.append(part)
            self.n += len(part)
            self.bytes += part["text"].nbytes
            if self.n >= SHARD or self.bytes >= SHARD_BYTES:
                yield self.close()

    def close(self) -> pa.Table:
        """The shard in the order of its bins; pieces of no tokens are in none."""
        table = pa.concat_tables(self.tables)
        self.tables, self.n, self.bytes = [], 0, 0
        lengths = table["n_tokens"].to_numpy()
        some = np.flatnonzero(lengths)
        bins, offsets, opened = pack(lengths[some].tolist(), self.sizes)
        number, size, start = (np.full(len(table), -1, dtype=np.int64) for _ in range(3))
        number[some], start[some] = np.array(bins, dtype=np.int64) + self.bin, offsets
        size[some] = np.array(opened, dtype=np.int64)[bins] if bins else 0
        self.bin += len(opened)
        for name, values in (("bin_id", number), ("bin_size", size), ("bin_start", start)):
            table = table.append_column(name, pa.array(values, mask=number < 0))
        return table.take(np.lexsort((start, number)))


def pieces(batch: pa.RecordBatch, counter: Counter, largest: int) -> Iterator[pa.Table]:
    """The pieces of a batch of id and text."""
    n, words, offsets = counter.batch(batch["text"])
    whole = pa.array(n <= largest)
    short = pa.Table.from_batches([batch]).filter(whole)
    size = pc.utf8_length(short["text"]).cast(pa.int64())
    none = pa.array(np.zeros(len(short), dtype=np.int64))
    yield pa.table({"id": short["id"], "piece": none, "start": none, "end": size, "n_tokens": pa.array(n[n <= largest]), "text": short["text"].cast(pa.large_string())})
    for k in np.flatnonzero(n > largest).tolist():
        text = batch["text"][k].as_py()
        parts = cut(text, words[offsets[k] : offsets[k + 1]], largest, counter)
        start, end, held = (pa.array(np.array(x, dtype=np.int64)) for x in zip(*parts, strict=True))
        yield pa.table({
            "id": pa.array([batch["id"][k]] * len(parts), batch["id"].type), "piece": pa.array(np.arange(len(parts))), "start": start, "end": end,
            "n_tokens": held, "text": pa.array([text[s:e] for s, e, _ in parts], pa.large_string()),
        })


def packed(docs: DataFrame, model: str, id_col: str, text_col: str, sizes: tuple[int, ...], shape, schema: str) -> DataFrame:
    """Packs the rows of each task and gives its shards in the shape."""
    from pyspark import TaskContext

    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        counter, shards = Counter(shipped.value), Shards(sizes, TaskContext.get().partitionId() << 32)
        for part in (part for whole in batches for batch in slices(whole) for part in pieces(batch, counter, max(sizes))):
            if len(part):
                for shard in shards.add(part):
                    yield from shape(shard)
        if shards.n:
            yield from shape(shards.close())
        release_memory()

    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInArrow(rows, schema)


def pack_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Packs the tokens of all documents; model is a vocabulary file readable by the driver.

    Returns one row per piece, in each partition in the order of the sequences:
    id, piece, start and end (characters of the whole text), n_tokens, bin_id,
    bin_size, bin_start (token offset in the sequence) and the piece's text.
    Counts are those of the whole text.  Null and empty texts are one piece of
    no tokens and no bin; a very long text has as many pieces as it needs;
    pieces of equal length are packed in the order in which they are read, and
    sizes of equal cost from the smallest; repeated rows are packed each; null
    ids stay null; other columns, whatever their names, are not read; an empty
    table gives an empty table.
    """

    def shape(shard: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from shard.to_batches(max_chunksize=2000)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece long, start long, end long, n_tokens long, text string, bin_id long, bin_size long, bin_start long"
    return packed(docs, model, id_col, text_col, sizes, lambda shard: shape(_plain(shard)), schema).withColumnRenamed("id", id_col)


def pack_sequences(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """The same, one row per sequence: bin_id, bin_size, n_tokens and pieces, an array of id, piece, start, end, n_tokens, bin_start and text in order.

    Texts of no tokens are in no sequence.
    """
    inner = ["id", "piece", "start", "end", "n_tokens", "bin_start", "text"]

    def shape(shard: pa.Table) -> Iterator[pa.RecordBatch]:
        shard = _plain(shard.filter(pc.is_valid(shard["bin_id"]))).combine_chunks()
        if not len(shard):
            return
        number, tokens = shard["bin_id"].to_numpy(), shard["n_tokens"].to_numpy()
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        struct = pa.StructArray.from_arrays([shard[c].combine_chunks() if shard[c].num_chunks != 1 else shard[c].chunk(0) for c in inner], inner)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(shard)).astype(np.int32)), struct)
        out = pa.table({"bin_id": shard["bin_id"].take(first), "bin_size": shard["bin_size"].take(first), "n_tokens": pa.array(np.add.reduceat(tokens, first)), "pieces": lists})
        yield from out.to_batches(max_chunksize=500)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"bin_id long, bin_size long, n_tokens long, pieces array<struct<id:{kind},piece:bigint,start:bigint,end:bigint,n_tokens:bigint,bin_start:bigint,text:string>>"
    return packed(docs, model, id_col, text_col, sizes, shape, schema)


def _plain(table: pa.Table) -> pa.Table:
    """With texts of the type that Spark takes; a shard's texts are far below its limit."""
    return table.set_column(table.column_names.index("text"), "text", table["text"].cast(pa.string()))
