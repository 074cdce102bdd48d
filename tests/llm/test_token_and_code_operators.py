"""BPE, fill-in-the-middle and vector codes: against the library, brute force and round trips."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickbasin.llm import bpe, codes, fim

FILE = "/opt/tokenizers/byte_bpe_50k.json"
ODD = ["a", "b", " ", "  ", "\n", "\t", "1", "23", "!", "'s", "'", "é", "à", "中", "\xa0", "　", " ", "<|endoftext|>", "<|endo", "the ", "ing", "\x1f", "\x00", "\U0001f600", "ſ", "՘", "꟎", "²"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary(FILE))


def same(encoder, library, texts):
    ids, at = encoder.batch(pa.array(texts, pa.large_string()))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:300])


def test_bpe_against_the_library(encoder, library):
    same(encoder, library, ["", "a", "two  spaces \n\n x", "I'm they'll 'S", "tab\t\tx\r\n y", "　a\xa0 b voilà le", "x <|endoftext|>  y<|endoftext|><|endoftext|>"])
    rng = random.Random(1)
    for _ in range(200):
        same(encoder, library, ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(20)])


def test_bpe_long_words_by_trees(encoder, library):
    """Unsplit text of every kind, periodic ones too, whose joins need long windows."""
    same(encoder, library, ["a" * 100_000, "ab" * 5000, "é" * 3000, "中文字" * 4000, "x" * 33, "=" * 40_001, " " * 70_000, "\n" * 50_000 + "x", "12" * 9000])
    rng = random.Random(2)
    for _ in range(60):
        letters = rng.choice(["ab", "abcdefghij", "aaab", "theiings", "0123456789", "!?#", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP", "éèàab"])
        same(encoder, library, ["".join(rng.choice(letters) for _ in range(rng.randint(33, 4000)))])


def test_bpe_windows_grow(encoder, monkeypatch):
    """From one token on each side the windows must grow, and the result stays."""
    words = [("".join(random.Random(k).choice("ab0") for _ in range(700))).encode() for k in range(20)]
    want = [x.tolist() for x in encoder.arrays(words)]
    monkeypatch.setattr(bpe, "WINDOW", 1)
    monkeypatch.setattr(bpe, "LEAF", 3)
    assert [x.tolist() for x in encoder.trees(words)] == want


def test_bpe_forgets(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    same(encoder, library, ["one two three", "four five six seven eight", "one " * 50 + "x" * 500])
    same(encoder, library, ["nine ten", "one two"])


def test_bpe_refuses_other_files(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        bpe.read_vocabulary("/opt/tokenizers/word_bpe_49k.json")


def test_bpe_tables(spark, library):
    texts = ["one two", None, "", "w " * 30_000 + "q" * 50_000, "one two", "é <|endoftext|> \n"]
    df = spark.createDataFrame([(1 if k in (0, 4) else k, t, "clash") for k, t in enumerate(texts)] + [(None, "n", "c")], "doc_id long, text string, ids string")
    encoded = bpe.encode_documents(df, FILE)
    got = sorted(((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect()), key=repr)
    want = [(k, t, library.encode(t or "", add_special_tokens=False).ids) for k, t in [*((1 if k in (0, 4) else k, t) for k, t in enumerate(texts)), (None, "n")]]
    assert got == sorted(((k, len(ids), ids) for k, _, ids in want), key=repr)
    decoded = bpe.decode_documents(encoded.withColumn("text", F.lit("clash")), FILE)
    assert decoded.columns == ["doc_id", "n_tokens", "text", "text_"]
    assert sorted(((r.doc_id, r.text_) for r in decoded.collect()), key=repr) == sorted(((k, t or "") for k, t, _ in want), key=repr)
    assert encoded.limit(0).count() == 0 and bpe.encode_documents(df.limit(0), FILE).count() == 0 and bpe.decode_documents(encoded.limit(0), FILE).count() == 0


def test_bpe_decodes_any_ids(spark, library):
    """Broken characters, special tokens and ids that are none."""
    rng = random.Random(3)
    rows = [(k, [rng.choice([rng.randrange(50_257), rng.randrange(256), 50_256]) for _ in range(rng.randint(0, 30))]) for k in range(200)] + [(200, [60_000, 64])]
    df = spark.createDataFrame([(k, np.array(ids, "<u4").tobytes()) for k, ids in rows] + [(201, None)], "k long, ids binary")
    for skip in (False, True):
        got = {r.k: r.text for r in bpe.decode_documents(df, FILE, skip_special=skip).collect()}
        assert got == {k: library.decode(ids, skip_special_tokens=skip) for k, ids in rows} | {201: None}


def slow_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, None, text
    parts = ["".join(u) for u in (units[:low], units[low:high], units[high:])]
    form = "spm" if h[3] % 100 < 80 else "psm"
    prefix, middle, suffix = parts
    return len(units), form, *parts, f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fim_against_the_rule(spark):
    rng = random.Random(4)
    odd = ["a", "word ", " ", "\n\t", "\x01", "\x02", "\x02a", "\x02b", "\x01\x02", "<P", "<", ">", "P>", "é", "中 ", "\U0001f600", "\xa0", "\x85", "$0", "\\"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["has <P>", "<S> x", "y<M>z", None, "", " ", "\x01" * 30, "w " * 200_000, "x" * 300_000]
    rows = [(k % 397, t, "clash", "c") for k, t in enumerate(texts)] + [(None, "null id words here", "c", "c"), (5, "again", "c", "c"), (5, "again", "c", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, escaped string, output string")
    made = fim.fill_in_middle(df)
    got = sorted(map(tuple, made.collect()), key=repr)
    assert got == sorted(((k, *slow_fim(k, t)) for k, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    back = fim.restored(made.withColumn("text", F.lit("clash")))
    assert sorted(((r.doc_id, r.text_) for r in back.collect()), key=repr) == sorted(((k, t or "") for k, t, *_ in rows), key=repr)
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    assert fim.restored(made.limit(1).withColumn("output", F.lit(None).cast("string"))).first().text is None


def test_fim_rates(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'a b c d' as text")
    n = {r.form: r["count"] for r in fim.fill_in_middle(df, rate=100, spm=50).groupBy("form").count().collect()}
    assert n.keys() == {"spm", "psm"} and abs(n["spm"] - 1500) < 150


def slow_codes(rows, parts=16, entries=64, rounds=2):
    """The contract's rule with plain integers."""
    kept = sorted(((k is None, k, v, label) for k, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0], r[1] or 0, r[2]))
    cells = [[[int(np.floor(256 * x)) for x in v[p * (len(v) // parts) : (p + 1) * (len(v) // parts)]] for p in range(parts)] for _, _, v, _ in kept]
    books = [[c[p] for c in cells[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cells:
            out.append([min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, f in zip(cells, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    total = {}
    out = []
    for (_, k, _, label), f in zip(kept, assign(), strict=True):
        error = sum(d for d, _ in f)
        total[label] = total.get(label, 0) + error
        out.append((k, label, "".join(f"{i:02x}" for _, i in f), error))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((k, label, code, error, total[label], sha) for k, label, code, error in out), key=repr)


def test_codes_against_the_rule(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 50)
    rng = np.random.default_rng(5)
    vectors = [[float(np.float32(x)) for x in v] for v in rng.normal(size=(300, 32))]
    rows = [(k % 290, v, int(k % 4) if k % 5 else None) for k, v in enumerate(vectors)]  # repeated ids
    rows += [(7, vectors[7], 1), (7, vectors[7], 1), (399, [], 1), (400, None, 1), (401, [float("nan")] * 32, 2), (402, [float("inf"), *[0.0] * 31], 2), (403, [None, *[0.0] * 31], 0), (None, vectors[0], None), (500, [0.0] * 32, 9)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(7)
    assert sorted(map(tuple, codes.compress(df).collect()), key=repr) == slow_codes(rows)
    few = df.where("vec_id < 10")
    assert sorted(map(tuple, codes.compress(few).collect()), key=repr) == slow_codes([r for r in rows if r[0] is not None and r[0] < 10])
    assert codes.compress(df.limit(0)).count() == 0 and codes.compress(df.where("vec_id = 400")).columns == codes.compress(df).columns


def test_codes_decode(spark):
    """Decoded vectors are near the originals, the nearer the more entries there are."""
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in v], None) for k, v in enumerate(rng.normal(size=(500, 32)))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    errors = []
    for entries in (4, 64):
        books = codes.train(df, entries=entries)
        back = {r.id: r.vec for r in codes.decode(codes.encode(df, books), books).collect()}
        errors.append(np.mean([np.sum((np.array(v) - np.array(back[k])) ** 2) for k, v, _ in rows]))
    assert errors[1] < errors[0] / 2 < 32 / 2


def test_codes_refuse_uneven_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 20, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(df)
    with pytest.raises(Exception, match="must have 16 components"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 16, 0), (2, [1.0] * 32, 0)], df.schema)).collect()
