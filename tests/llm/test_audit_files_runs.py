"""Filter audit, token-id files and periodic runs against plain versions."""

import hashlib
import io
import os
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from whorl.llm import filter_audit, periodic, queries, token_files
from whorl.llm.common import Scratch

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WIDE = "doc_id bigint, text string, lang string, id bigint, part string, digest string, runs string, start string, ids string, n int, good int, A boolean, words int, `dotted.name` string"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, x, 1, "p", "d", "r", "s", "i", 2, 3, True, 4, "o") for i, t, x in rows], WIDE).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    many = " ".join(f"w{i % 190}" for i in range(400))
    return [(1, "one two", "en"), (1, "one two", "en"), (1, "one two", "fr"), (2, "one two", "en"), (3, None, None), (4, "", ""), (None, "", None), (None, "one two", "en"), (5, many, "en"), (6, many + " #", "en"), (7, "A B C " * 300, "de"), (8, "la la " * 120_000, "de"), (9, "é́ " * 7 + "x", "de")]


def audit(rows, labels):
    """The audit, row by row and order by order."""
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    first, flags = {}, []
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, t, lang in rows:
        t, w = t or "", WORD.findall(t or "")
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > first[t]]
        flags.append((lang or "", {k for k, f in zip("ABCDE", fails, strict=True) if f}, d))
    out, total = {}, {}
    for part in {p for p, *_ in flags}:
        own = [(f, d) for p, f, d in flags if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [(f, d) for f, d in left if k in f]
                left = [x for x in left if k not in x[0]]
                fails = [f for f, _ in own if k in f]
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(f == {k} for f in fails), sum(d in good for _, d in gone), sum(d in toxic for _, d in gone), k]
                total[part, k] = total.get((part, k), 0) + len(gone)
    return {key: (*v[:-1], total[key[0], v[-1]]) for key, v in out.items()}


def test_audit_of_odd_rows_equals_a_plain_count(spark, odd):
    labels = [(1, 1, 0), (1, 0, None), (2, 1, 1), (5, None, 1), (None, 1, 1), (99, 1, 1), (8, 0, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.filter_audit(wide(spark, odd), table).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got} == audit(odd, labels)
    assert len(got) == 600 * 4


def test_audit_of_an_empty_table(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert filter_audit.filter_audit(wide(spark, odd).limit(0), labels).count() == 0
    assert filter_audit.filter_audit(wide(spark, odd), labels.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*own.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_and_files_round_trip(bits):
    rng = np.random.default_rng(3)
    docs = [(7, rng.integers(0, 1 << 32, 1000)), (None, rng.integers(0, 50, 0)), (-3, rng.integers(0, 49408, 333)), (9, np.zeros(64, int)), (2**62, rng.integers(0, 2, 70))]
    docs = [(d, ids.astype(np.uint32)) for d, ids in docs]
    for _, ids in docs:
        assert (token_files.from_planes(token_files.to_planes(ids, bits), len(ids), bits) == ids).all()
    stream = io.BytesIO()
    writer = token_files.FileWriter(stream, bits, block=64)
    for d, ids in docs:
        writer.add(d, ids)
    assert writer.close() == len(stream.getvalue())
    read = token_files.FileReader(stream)
    flat = np.concatenate([ids for _, ids in docs])
    assert read.doc_ids == [d for d, _ in docs] and list(read.lengths) == [len(ids) for _, ids in docs]
    for start, n in [(0, len(flat)), (63, 2), (64, 64), (1400, 500), (5, 0), (len(flat), 1)]:
        assert (read.read(start, n) == flat[start : start + n]).all()
    with pytest.raises(ValueError):
        token_files.FileReader(io.BytesIO(stream.getvalue()[:-1]))


def test_encoding_piece_by_piece_equals_the_library():
    import public_tokenizers

    rng = random.Random(11)
    bits = ["a", "Ab", "don't", "'", "s", "é", "é", "́", "İ", "Σ", "12", "…", " ", "\u0085", " ", "\x1c", " ", "  ", "\t", "\n", "\r\n", "<|endoftext|>", "日本", "ﬁ", "<|", "̈", "x" * 90]
    bits += ["Ünï", "ß", "ǅ", "ª", "½", "²", "…", "–", "€", "'re", "'LL", "we'll", "_", "-", "ſ", "µ", "×", "÷"]
    latin = [b for b in bits if not pc.match_substring_regex(pa.array([b]), token_files._OTHER)[0].as_py()]
    assert len(latin) > 25
    texts = ["".join(rng.choice(latin) for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)]
    own = token_files.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert [ids.tolist() for ids in own.encode(pa.array(texts), 1)] == plain_ids(texts)


def test_files_of_odd_rows(spark, odd):
    import public_tokenizers

    folder = f"{Scratch(spark, 'test-files').root}/ids"
    manifest = token_files.write_token_files(wide(spark, odd), folder, public_tokenizers.path("word_bpe_49k.json"), block=100, file_ids=50)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, None]
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(d), np.array(ids, "<u4").tobytes()) for (d, *_), ids in zip(odd, plain_ids(t for _, t, _ in odd), strict=True))
    flat = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) // 4 for r in got)])[:-1].tolist()
    for start, n in [(0, 5), (3, 400), (200_000, 1000), (len(flat) - 3, 3), (0, len(flat))]:
        assert (token_files.read_ids(spark, folder, start, n) == flat[start : start + n]).all()
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(odd) and manifest.count() > 3
    empty = f"{Scratch(spark, 'test-files').root}/ids"
    token_files.write_token_files(wide(spark, odd).limit(0), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, empty).count() == 0


def test_files_left_by_lost_attempts_are_not_read(spark):
    import public_tokenizers

    folder = f"{Scratch(spark, 'test-files').root}/ids"
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    token_files.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    store, root = token_files.open_folder(folder)
    with store.open_output_stream(f"{root}/ids-000000-0000-lost.tok") as stream:
        stream.write(b"half a file")
    assert token_files.read_token_files(spark, folder).count() == 2


def test_registered_token_files_equal_the_library(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    want, start = [], 0
    for r, ids in zip(docs, plain_ids(r.text for r in docs), strict=True):
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.QUERIES["op12_token_files"](spark, SF).collect()) == want


def plain_runs(x, min_exp=4, min_length=6):
    n, out = len(x), []
    for q in range(1, n // min_exp + 1):
        same, i = np.array(x[:-q]) == np.array(x[q:]), 0
        while i < n - q:
            if not same[i]:
                i += 1
                continue
            b = i
            while i < n - q and same[i]:
                i += 1
            length = i - b + q
            if length >= max(min_length, min_exp * q) and not any((np.array(x[b : b + length - p]) == np.array(x[b + p : b + length])).all() for p in range(1, q)):
                out.append((b, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(words):
    runs = plain_runs([*map({w: i for i, w in enumerate(dict.fromkeys(words))}.get, words)])
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_of_random_words_equal_a_plain_scan(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(periodic, "PLACES", 64)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(70)
        x = [rng.randrange(k) for _ in range(n)]
        if n > 8 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        e, m, cut = rng.choice([2, 3, 4, 4]), rng.choice([1, 6]), rng.randint(1, 8)
        ids = np.array(x, np.int32)
        want = plain_runs(x, e, m)
        assert periodic.find_runs(ids, min_exp=e, min_length=m) == want
        assert sorted(periodic.find_runs(ids, 1, cut, e, m) + periodic.find_runs(ids, cut, None, e, m), key=lambda r: (r[0], r[2])) == want


def test_long_texts_by_ranges_of_shifts_equal_the_scan_in_place(spark, odd):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(300))), "en") for i in range(40)] + [r for r in odd if r[0] != 8]
    rows += [(100 + k, " ".join(f"v{i % (60 + k)}" for i in range(900)), "en") for k in range(5)]
    want = sorted((str(d), *plain_row(WORD.findall(t or ""))) for d, t, _ in rows)
    for long_chars in (periodic.LONG_CHARS, 100, 3):
        got = periodic.run_digests(periodic.periodic_runs(wide(spark, rows), long_chars=long_chars)).collect()
        assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == want
    assert periodic.periodic_runs(wide(spark, rows).limit(0), long_chars=100).count() == 0
    one = periodic.run_digests(periodic.periodic_runs(wide(spark, [r for r in odd if r[0] == 8]))).first()
    assert (one.n_runs, one.start, one.length, one.period, one.exponent_milli) == (1, 0, 240_000, 1, 240_000_000)


def test_registered_runs_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r.doc_id, *plain_row(planted(r.doc_id, WORD.findall(r.text or "")))) for r in docs)
    got = sorted(tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect())
    assert got == want
    assert sum(r[1] > 0 for r in got) > 5


def test_planting_leaves_rows_without_words_or_id(spark):
    rows = [(i, t) for i in [*range(60), None] for t in (None, "", " \n", "w", "a b c d e f g h i j k l")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = df.select("doc_id", "text", periodic.planted(df.doc_id, df.text).alias("made")).collect()
    assert all(WORD.findall(r.made or "") == planted(r.doc_id, WORD.findall(r.text or "")) for r in got)
