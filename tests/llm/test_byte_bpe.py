import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from flowpane.llm.byte_bpe import ENCODED_PIECES, ENCODED_SEGMENTS, BytePairs, Pieces, decode, encode, merge_long, round_trip, segments
from flowpane.llm.vocab import byte_encoding


def test_segments_and_merges_equal_the_library():
    rng, library, pairs = random.Random(2), byte_encoding(), BytePairs()
    texts = ["".join(rng.choice("abethion'sdé ñ \n\t.,12\x0b\xa0 日\0") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["A plain line.\nAnd 'tis the next one, ok", "x" * 300, "ha" * 400 + " é" * 90, "thnondtionha " * 30]
    import public_tokenizers
    import regex
    cut = regex.compile(public_tokenizers.PATTERN).findall
    for t in texts:
        pieces = [p for x in segments(t) for p in cut(x)]
        assert pieces == cut(t), t
    flat = [p.encode() for t in texts for p in cut(t)]
    lens, tokens = pairs.encode(flat)
    want = [library.encode_ordinary(p.decode()) for p in flat]
    assert tokens.tolist() == [i for x in want for i in x] and lens.tolist() == [len(x) for x in want]
    assert pairs.decode(lens, tokens) == flat
    word = b"thnondtionhaerlyingtheaaaaaaaaaaa"
    assert merge_long(pairs.base[list(word)].tolist(), pairs.merge_of) == library.encode_ordinary(word.decode())


def test_documents(spark):
    texts = ["One two,  three\n\n four", "", None, "é" * 2000, "again and again " * 2000, "x\0y z"]
    rows = [("i", i, t, "b") for i, t in enumerate(texts)] + [(None, None, "null id", None)] * 2
    docs = spark.createDataFrame(rows, "ids string, doc_id long, text string, bytes string")
    want = {i: byte_encoding().encode_ordinary(t or "") for i, t in enumerate(texts)} | {None: byte_encoding().encode_ordinary("null id")}
    got = encode(docs)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == want
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in decode(got).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} | {None: "null id"}
    digests = round_trip(docs).collect()
    assert len(digests) == len(rows)
    for r in digests:
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((back[r["doc_id"]]).encode()).hexdigest()
    assert encode(docs.filter(F.lit(False))).count() == round_trip(docs.filter(F.lit(False))).count() == 0


def test_worker_that_wants_ids_keeps_little():
    pieces, library = Pieces(), byte_encoding()
    assert not isinstance(pieces.pairs.merge_of, dict)  # all pairs are in DuckDB already
    words = [f" w{i}x" for i in range(50)]
    pieces.table.limit = 20  # of a segment each; the next group starts anew, and the pieces with it
    want = [library.encode_ordinary(w) for w in words]
    for some, own in ((words[:30], want[:30]), (words[25:], want[25:])):
        at, _ = pieces.table.numbers([some])
        assert pieces.table.ragged.take(at).tolist() == [i for x in own for i in x]
    assert " w" in pieces.known and not {w for w in pieces.known if w.isdigit() and int(w) < 25}
    assert pieces.most == ENCODED_PIECES < Pieces(digest=True).most and Pieces().table.limit == ENCODED_SEGMENTS
    lens, tokens = pieces.pairs.encode([b"qzqzq", b"zqzqz"])
    assert pieces.pairs.decode(lens, tokens) == [b"qzqzq", b"zqzqz"] and lens.sum() == len(tokens) and tokens.dtype == np.int32
    kept = {r[0] for r in pieces.pairs.db.execute("SELECT table_name FROM duckdb_tables()").fetchall()}
    assert kept == {"merges", "vocabulary"}  # no rows of a query stay
