import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from babelshelf.llm import binary, counts, packing, tokens
from babelshelf.llm.common import shared_path


@pytest.fixture(scope="module")
def library():
    return tokens.load(tokens.tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_pieces_match_library(library):
    dice = random.Random(1)
    parts = [" ", "\n", "a", "b", "'s", "'", "<|endoftext|>", "<|endof", "\t", "\r", " ", "　", "9", "é", ".", "!", "  ", "\x1c", "\x85", "日本", "\x00", "l"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randrange(10))) for _ in range(5000)]
    enc = tokens.PieceEncoder(tokens.tokenizer_path())
    assert enc.by_piece
    ends, ids = enc(pa.array(texts, pa.large_string()))
    starts = [0, *ends.tolist()]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [ids_of(library, t) for t in texts]
    n = counts.count_tokens(pa.array(texts, pa.large_string()), enc, counts.LengthTable(["a"], [1]), tokens.Generations(10))
    assert n.tolist() == [len(ids_of(library, t)) for t in texts]


def test_other_vocabulary_is_encoded_whole():
    enc = tokens.PieceEncoder(tokens.tokenizer_path("word_bpe_49k.json"))
    texts = ["Hello  World\nagain", "", "a b"]
    ends, ids = enc(pa.array(texts, pa.large_string()))
    assert ids.tolist() == [i for t in texts for i in ids_of(enc.tokenizer, t)]


def test_generations_stay_bounded():
    cache = tokens.Generations(3)
    for i in range(10):
        cache.put(i, str(i))
    assert len(cache.young) <= 3 and len(cache.old) <= 3 and cache.find([9, 0]) == ["9", None]
    cache.put_all(list(range(20, 28)), list(map(str, range(20, 28))))
    assert len(cache.young) <= 3 and len(cache.old) <= 3 and cache.find([27, 26, 9]) == ["27", "26", None]


def test_safe_pieces_by_pattern():
    dice = random.Random(3)
    parts = ["\n", " ", "\t", "a", "é", "日", "\x85", "\xa0", "\u3000", "\x1c", "\u200b", ".", "-", "]", "^", "\u2028", "\x0b"]
    pieces = ["".join(dice.choice(parts) for _ in range(dice.randrange(6))) for _ in range(5000)]
    assert tokens.safe(pa.array(pieces, pa.large_string())).tolist() == [tokens.is_safe(p) for p in pieces]


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_counts(request, library, table):
    df = request.getfixturevalue(table)
    found = sorted(map(tuple, counts.token_counts(df).collect()), key=key)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(ids_of(library, r.text)), n > 512) for r in df.collect()), key=key)
    assert found == want


def test_table_holds_the_vocabulary_s_words(library):
    table = counts.frequent_lengths(tokens.tokenizer_path())
    pieces = table.pieces.to_pylist()
    assert 30_000 < len(pieces) == len(set(pieces)) <= library.get_vocab_size() and {"the", "of", "und"} <= set(pieces)
    assert table.lengths.tolist() == [len(ids_of(library, tokens.as_text(w))) for w in pieces]
    assert table.find(pa.array(["the", "no such piece at all", ""], pa.large_string())).tolist() == [1, -1, -1]


def test_table_probes_and_confirms(monkeypatch):
    """With hashes of few values slots are contested and pieces share a hash; a found piece is always the right one."""
    pieces = [f"p{i}" for i in range(300)]
    whole = counts.LengthTable(pieces, list(range(300)))
    asked = pa.array([*pieces, "x", "", "p" * 100, *(f"q{i}" for i in range(300))], pa.large_string())
    assert whole.find(asked).tolist() == [*range(300), *[-1] * 303] and (whole.hashes > 0).sum() == 300 <= len(whole.hashes) / 2
    real = counts.hashes_of
    monkeypatch.setattr(counts, "hashes_of", lambda words: real(words) % np.uint64(200) + np.uint64(1))
    crowded = counts.LengthTable(pieces, list(range(300)))
    found = crowded.find(asked).tolist()
    assert all(x in (i, -1) for i, x in enumerate(found[:300])) and set(found[300:]) == {-1} and len(set(found)) - 1 == (crowded.hashes > 0).sum() > 100
    assert counts.LengthTable([], []).find(asked).tolist() == [-1] * len(asked) and whole.find(asked[:0]).tolist() == []


def test_table_holds_what_is_frequent(documents, odd, none):
    """Most pieces are found in a table filled from a sample; whatever it holds, counts are the same."""
    texts = pa.array([r.text or "" for r in documents.collect()], pa.large_string())
    _, index, words = tokens.split(texts)
    share = [(counts.frequent_lengths(tokens.tokenizer_path(), some).find(words)[index] >= 0).mean() for some in ([], counts.sampled(documents))]
    assert share[0] < 0.4 < 0.6 < share[1]
    assert counts.sampled(none) == [] and len(counts.sampled(odd)) <= counts.SAMPLE_DOCS


def test_nothing_is_shuffled_for_counts(documents):
    plan = counts.token_counts(documents)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("width", [1, 5, 11, 16, 17, 31, 32])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003).astype("<u4")
    raw = binary.pack(ids, width)
    assert len(raw) == (1003 * width + 7) // 8 and (binary.unpack(raw, 1003, width) == ids).all()


def test_width():
    assert [binary.width_for(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_random_access(tmp_path):
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 3000, n).astype("<u4") for n in (0, 3, 100, 1, 257, 0, 64)]
    with pafs.LocalFileSystem().open_output_stream(str(tmp_path / "x")) as out:
        w = binary.Writer(out, 12, block_ids=64)
        for i, d in enumerate(docs):
            w.add(None if i == 3 else i, d)
        w.close()
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as source:
        r = binary.Reader(source, block_ids=64)
        assert [r.document(i).tolist() for i in (4, 0, 6, 2)] == [docs[i].tolist() for i in (4, 0, 6, 2)]
        assert [(i, d.tolist()) for i, d in r.documents()] == [(None if i == 3 else i, d.tolist()) for i, d in enumerate(docs)]
    (tmp_path / "y").write_bytes((tmp_path / "x").read_bytes()[:-3])
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "y")) as source, pytest.raises(ValueError):
        binary.Reader(source, block_ids=64)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_binary_files(request, spark, library, table):
    df = request.getfixturevalue(table)
    files = binary.write_token_files(df, shared_path(spark, "test-bin"))
    found = binary.read_token_files(files, 3).collect()
    # Rows with one id stand in the order of the signed hash of their texts, which is the seed for null.
    signed = lambda text: ((42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)) + (1 << 63)) % (1 << 64)
    rows = sorted((r.doc_id is not None, r.doc_id or 0, signed(r.text), r.text or "") for r in df.collect())
    at, want = 0, []
    for has_id, doc_id, _, text in rows:
        ids = [*ids_of(library, text), 0]
        want.append((doc_id if has_id else None, at, struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, bytes(r.ids)) for r in found), key=lambda x: x[1]) == want


def test_repeated_ids_are_dealt_to_several_files(spark):
    rows = [(None, "the same text")] * 4000 + [(7, f"text {i}") for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = binary.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shared_path(spark, "test-bin"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n_docs = [r.n_docs for r in files.collect()]
    assert sum(n_docs) == 6000 and len(n_docs) == 4 and max(n_docs) < 3000


def test_binary_empty(spark, none):
    assert binary.read_token_files(binary.write_token_files(none, shared_path(spark, "test-bin")), 1).count() == 0


@pytest.mark.parametrize("table", ["odd", "documents"])
@pytest.mark.parametrize("fan_in", [64, 2])
def test_packing(request, library, table, fan_in):
    df = request.getfixturevalue(table)
    pieces = packing.pack_documents(df, windows=4, fan_in=fan_in).collect()
    whole = defaultdict(list)
    for r in df.collect():
        whole[r.doc_id].append([*ids_of(library, r.text), 0])
    got, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        got[p.doc_id].append((p.doc_tokens, p.start, ids))
        sequences[p.sequence_id].append((p.offset, p.length))
    for doc_id, docs in whole.items():
        # Of rows with one id, those of equal length may be taken for each other.
        assert sorted(i for d in docs for i in d) == sorted(i for _, _, ids in got[doc_id] for i in ids)
        if len(docs) == 1:
            parts = sorted(got[doc_id])
            assert [i for _, _, ids in parts for i in ids] == docs[0] and {n for n, _, _ in parts} == {len(docs[0])}
            assert [s for _, s, _ in parts] == [sum(len(x[2]) for x in parts[:k]) for k in range(len(parts))]
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 1024 - at
    assert padding <= packing.SLACK * len(sequences) + 1024


def test_packing_empty(none):
    assert packing.pack_documents(none).count() == 0


def test_crc_matches_zlib(spark):
    raw = struct.pack("<3I", 1, 50_000, 0)
    assert spark.createDataFrame([(bytearray(raw),)], "x binary").select(F.crc32("x")).first()[0] == zlib.crc32(raw)
