import gc
import zlib

import numpy as np
import pytest

from flowpane.llm import token_files, vocab
from flowpane.llm.common import scratch_path
from flowpane.llm.token_files import CodeBook, block_ids, code_lengths, document_ids, lane_starts, read_book, read_tokens, write_tokens
from flowpane.llm.vocab import word_tokenizer


def frame(spark, rows):
    return spark.createDataFrame(rows, "part string, doc_id long, text string, ids int, n long")


def test_code_lengths_are_optimal_under_the_limit():
    counts = np.array([1, 1, 2, 4, 8, 16, 32, 64])
    free, held = code_lengths(counts, 18), code_lengths(counts, 4)
    assert free.tolist() == [7, 7, 6, 5, 4, 3, 2, 1]
    assert held.max() == 4 and sum(2.0 ** -int(x) for x in held) <= 1
    best = min((sum(c * x for c, x in zip(counts, ls)), ls) for ls in _lengths(8, 4))
    assert int((counts * held).sum()) == best[0]
    assert code_lengths(np.array([5])).tolist() == [1]


def _lengths(n, limit):
    import itertools
    return (x for x in itertools.combinations_with_replacement(range(limit, 0, -1), n) if sum(2.0 ** -k for k in x) <= 1)


def test_codes_round_trip_from_every_checkpoint():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 5000), 900)
    met, times = np.unique(ids, return_counts=True)
    codes = CodeBook(met, code_lengths(times))
    lens = np.array([1, 255, 256, 257, 0, 700, 5000 - 1469])
    payload, sizes, checks = codes.encode(ids, lens)
    assert len(payload) == sizes.sum()
    lanes = (lens + 255) // 256
    offsets = checks + np.repeat((np.cumsum(sizes) - sizes) * 8, lanes)
    assert (codes.decode(payload, offsets, lane_starts(lens)[1]) == ids).all()
    row = {"doc_lens": lens.tolist(), "payload": payload, "checkpoints": offsets.astype("<u8").tobytes()}
    assert (block_ids(codes, row) == ids).all()
    assert (document_ids(codes, row, 5, 300) == ids[769 + 300 : 769 + 700]).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_files_give_back_what_the_library_encodes(spark, parts):
    texts = ["The cat, the CAT's mat.", "", None, "naïve façade ½ Σίσυφος 日本", "a" * 3000, "<|endoftext|> x", "word " * 9000, " \t\n"]
    rows = [("x", i * 7 - 3, t, 1, 2) for i, t in enumerate(texts)] + [("y", 4, "again", 0, 0), ("y", 4, "again", 0, 0), (None, None, "no id", None, None)]
    path = write_tokens(frame(spark, rows), scratch_path(spark, "tokens"), parts=parts)
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r["start"])
    encode = lambda t: [*word_tokenizer().encode(t or "", add_special_tokens=False).ids, 1]
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or ""))
    assert [r["doc_id"] for r in got] == [r[1] for r in want]
    start, by_id = 0, {}
    for r in want:
        by_id.setdefault(r[1], []).append(encode(r[2]))
    for r in got:
        ids = by_id[r["doc_id"]]
        assert r["ids"] in ids and r["n_tokens"] == len(r["ids"]) and r["start"] == start
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]


def test_empty_table(spark):
    path = write_tokens(frame(spark, []), scratch_path(spark, "tokens"))
    assert read_tokens(spark, path).count() == 0
    assert len(read_book(spark, path)[0]) == 0


def test_end_ids_outlast_the_caches_of_a_worker(monkeypatch):
    monkeypatch.setattr(token_files, "_TABLES", {})
    monkeypatch.setattr(token_files, "TABLE_CHUNKS", 20)
    monkeypatch.setattr(vocab, "KNOWN_PRETOKENS", 10)
    table = token_files.word_ids_table(vocab.WORD_BPE)
    for k in range(40):
        words = [f"w{chr(97 + k % 26)}{chr(97 + j)}{'x' * (k // 26)}" for j in range(8)]
        at, _ = table.numbers([[*words, token_files._END]])
        assert table.ragged.take(at).tolist() == [*word_tokenizer().encode(" ".join(words), add_special_tokens=False).ids, 1]
    assert table.dropped


def test_chunks_cut_in_arrow():
    """White space of any kind cuts, the four separators do not, and each different chunk is looked up once."""
    import numpy as np
    import pyarrow as pa

    from flowpane.llm.common import SegmentTable
    from flowpane.llm.vocab import space_chunk_lists, space_chunks

    texts = ["", " ", "one two\tone\x85two one​two ", "\n a\x0bb　a", "a\x1cb a"]
    for some in (texts[:4], texts):
        lists = space_chunk_lists(pa.array(some))
        assert [[c for c in x if c] for x in lists.to_pylist()] == [space_chunks(t) for t in some]
        asked = []
        table = SegmentTable(lambda new: (asked.extend(new), (np.ones(len(new), np.int64), np.arange(len(new))))[1])
        at, counts = table.numbers_of(lists)
        again, same = table.numbers(lists.to_pylist())
        assert (at == again).all() and (counts == same).all() and len(asked) == len(set(asked)) == len(table.index)
        assert table.number(" ") == len(table.index) - 1 and table.number(" ") == len(table.index) - 1


def test_kept_ids_are_out_of_the_collectors_reach():
    encoder = vocab.WordEncoder()
    chunks = ["Well-known", "it's", "x1y2", "word,", "日本", "word,"]
    lens, ids = encoder.values_of(chunks)
    want = [word_tokenizer().encode(c, add_special_tokens=False).ids for c in chunks]
    assert lens.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    gc.collect()
    assert encoder.known and not any(map(gc.is_tracked, encoder.known.values()))
