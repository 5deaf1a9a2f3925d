import random

from pyspark.sql import functions as F

from flowpane.llm.token_counts import Merges, PrefixCounter, longest_within, prefix_counts, token_counts, tokens_before
from flowpane.llm.vocab import space_chunks, word_tokenizer


def library(text):
    return len(word_tokenizer().encode(text, add_special_tokens=False).ids)


def test_counts_of_every_prefix_are_those_of_the_library():
    counter, rng = PrefixCounter(), random.Random(5)
    parts = ["Hello,", "thnondtion", "ciónbo", "don't", "we'll", "x'r", "é" * 3, "a" * 70, "...,!", "日本語", "<|endoftext|>x", "y<|startoftext|>",
             "12½", "STRASSE", "ünïcödé", "'ve", "wh\x1cat", "lowei'mä"]
    parts += ["".join(rng.choice("etaoinshrdlu'é,ñ") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    for chunk in parts:
        normal = word_tokenizer().normalizer.normalize_str(chunk)
        assert counter.chunk(chunk) == [library(normal[:k]) for k in range(1, len(normal) + 1)], chunk


def test_whole_texts_and_questions(spark):
    texts = ["The quick brown fox's tail.\n\nAgain  and again", "", None, "  lead and trail \t", "word " * 3000 + "lastly", "x" * 5000, " "]
    rows = [("c", i, t, 3) for i, t in enumerate(texts)] + [("d", None, "no id", 1), ("d", None, "no id", 1)]
    docs = spark.createDataFrame(rows, "counts string, doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in token_counts(docs).collect()}
    assert len(got) == len(texts) + 1 and token_counts(docs).count() == len(rows)
    for i, t in enumerate(texts):
        r, normal = got[i], word_tokenizer().normalizer.normalize_str(t or "")
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), library(t or ""), library(t or "") > 2048)
        assert library(normal[: r["chars_within"]]) <= 2048
        assert r["chars_within"] == len(normal) or library(normal[: r["chars_within"] + 1]) > 2048
    small = docs.filter("doc_id < 4")
    for r in prefix_counts(small).select("doc_id", "counts", tokens_before(9).alias("b"), longest_within(3).alias("w")).collect():
        normal = word_tokenizer().normalizer.normalize_str(texts[r["doc_id"]] or "")
        assert r["counts"] == [library(normal[:k]) for k in range(1, len(normal) + 1)]
        assert r["b"] == library(normal[:9])
        assert r["w"] == max([k for k in range(len(normal) + 1) if library(normal[:k]) <= 3])
    assert token_counts(docs.filter(F.lit(False))).count() == 0
    assert space_chunks(" a\x1cb c ") == ["a\x1cb", "c"]


def test_words_that_begin_alike_share_work():
    class Counted(set):
        looks = 0

        def __contains__(self, token):
            Counted.looks += 1
            return super().__contains__(token)

    merges, rng = Merges(), random.Random(3)
    merges.whole = Counted(merges.whole)
    words = ["".join(rng.choice("aenrst") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    words += [w[: rng.randint(1, len(w))] for w in words] + [w + "s" for w in words]
    alone = {}
    for w in words:
        merges.asked, merges.last, merges.count, merges.ended = "", [""], [0], []
        alone[w] = merges.prefix_counts(w)
    each, Counted.looks = Counted.looks, 0
    assert [merges.prefix_counts(w) for w in words] == [alone[w] for w in words]
    Counted.looks = 0
    assert [merges.prefix_counts(w) for w in sorted(words)] == [alone[w] for w in sorted(words)]
    assert 3 * Counted.looks < 2 * each
