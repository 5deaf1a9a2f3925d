import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from flowpane.llm.fertility import bands, judged, measured, repeated_words
from flowpane.llm.vocab import byte_encoding, piece_processor


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_repeated_words():
    assert repeated_words(np.array([1, 2, 3, 9, 1, 2, 3])) == 6
    assert repeated_words(np.array([1, 1, 1, 1])) == 4 and repeated_words(np.array([1, 1, 1])) == 0


def test_documents(spark):
    rng = random.Random(3)
    words = ["the", "house", "river", "stone", "walks", "under", "green", "quiet", "morning", "light", "bridge", "carries", "water"]
    texts = [" ".join(rng.choices(words, k=rng.randint(60, 150))) + rng.choice(["", "\nsame line\nsame line\n \n"]) for _ in range(200)]
    odd = [" ".join(w.upper() + "!!%%" for w in rng.choices(words, k=80)), " ".join("ꙮ꙰𐍈" + rng.choice("ⰀⰁⰂⰃ") for _ in range(90))]
    texts += [*odd, "", None, "short", "a b c " * 60, "x\x1cy z\xa0w\x0bq #$", "tail " * 20000, "é\r\né\r\n"]
    rows = [("b", i, t, "en" if i % 2 else None, 1) for i, t in enumerate(texts)] + [("b", None, texts[0], "en", 1)] * 2
    docs = spark.createDataFrame(rows, "kept string, doc_id long, text string, lang string, n_words int")
    got = judged(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        r, want = by_id[i], brute(t or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if want[0]:
            ids = [x for w in re.findall(r"[^\x20\x09-\x0D]+", t) for x in piece_processor().encode(w)]
            n = collections.Counter(ids)
            assert math.isclose(r["entropy"], -sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values()), abs_tol=1e-9)
            assert math.isclose(r["piece_chars"], want[1] / len(ids))
            assert math.isclose(r["byte_chars"], want[1] / sum(len(byte_encoding().encode_ordinary(w)) for w in re.findall(r"[^\x20\x09-\x0D]+", t)))
            assert math.isclose(r["fallback_share"], sum(map(piece_processor().is_byte, ids)) / len(ids))
    assert not by_id[200]["kept"] and not by_id[201]["kept"]
    assert sum(by_id[i]["kept"] for i in range(200)) >= 198
    fences = {r["lang"]: r for r in bands(measured(docs)).collect()}
    assert {"en", "script:latin"} <= set(fences)
    assert judged(docs.filter(F.lit(False))).count() == 0
