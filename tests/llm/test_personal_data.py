import hashlib
import random
import re

from pyspark.sql import functions as F

from flowpane.llm.personal_data import KINDS, Judge, op10_personal_data, personal_data, redact, train

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for no, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None,
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), no, kind, m.end()))
    return sorted(out)


def test_base_spans_against_the_rules(spark):
    rng = random.Random(9)
    bits = ["a.b@c.de", "x@y", "@z.w_", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485",
            "+49", "12", " ", ".", "-", "é", "日", "\n", "word", "+", "(", "a.b@c.de_f@g.hi", "4111  1111", "\x01", "\x02", "0000000000000", "%", "a@b.c.d-e.f"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(700)]
    texts += ["9" * 50000, "a" * 60000 + "@", "1.1." * 9000, "+1" + " 2" * 20000, "a.b@c.de " * 3000, "", None, "1-" * 30000, "x@" + "a." * 20000 + "b"]
    rows = [("t", i, t) for i, t in enumerate(texts)] + [("t", None, "10.0.0.1")] * 2
    docs = spark.createDataFrame(rows, "kind string, doc_id long, text string")
    got = personal_data(docs, Judge(None, {})).select("doc_id", "__base", "__spans", *[f"__{k}" for k in KINDS]).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r["doc_id"]] or "") if r["doc_id"] is not None else [(0, 1, "ip", 8)]
        assert [tuple(x) for x in r["__base"]] == want == [tuple(x) for x in r["__spans"]], texts[r["doc_id"]]


def test_proposals_are_learned_and_redacted(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        d = "".join(rng.choices("0123456789", k=15))
        card = next(d + c for c in "0123456789" if luhn(d + c))
        wrong = d + str((int(card[-1]) + 3) % 10)
        rows.append((i, f"text number {i} mail name.{i}@host{i % 7}.example.com or call +1 (988) 555-{i:04d} from 10.{i % 256}.3.4, card {card} not {wrong} ok", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    judge = train(docs)
    assert judge.thresholds
    new = spark.createDataFrame([(1, "write to jane.doe [at] mail [dot] example.com or 10.0.0.7 now", 5), (2, "nothing here", 12), (3, None, None), (4, "", 0)], docs.schema)
    out = {r["doc_id"]: r for r in redact(new, judge).collect()}
    assert "10.0.0.7" not in out[1]["text"] and "[IP] now" in out[1]["text"] and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "nothing here" and out[3]["text"] is None and out[4]["text"] == ""
    back = {r["doc_id"]: r["text"] for r in redact(docs, judge).collect()}
    assert all(not re.search(r"@|\+1|[0-9]\.[0-9]", t) and "not " in t for t in back.values())
    empty = docs.filter(F.lit(False))
    assert redact(empty).count() == 0


def test_other_forms_are_added(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        d = "".join(rng.choices("0123456789", k=15))
        card = next(d + c for c in "0123456789" if luhn(d + c))
        wrong = d + str((int(card[-1]) + 3) % 10)
        other = "".join(rng.choices("0123456789", k=rng.randint(8, 14)))
        rows.append((i, f"words {i} of name.{i}@host{i % 7}.example.com then +1 (988) 555-{i:04d} and 10.{i % 256}.3.4, or {card} but {wrong} or {other} ok"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judge = train(docs)
    assert set(judge.thresholds) == {0, 1, 2, 3}
    cases = {
        "some jane.doe [at] mail [dot] example.com or": "some [EMAIL] or", "some jane.doe(at)mail.example.com. Then": "some [EMAIL]. Then",
        "then 1 (988) 555-2485 and": "then [PHONE] and", "then (988) 555-2485 and": "then [PHONE] and", "or 4111.1111.1111.1111 but": "or [CARD] but",
        "and 10 . 0 . 3 . 4, or": "and [IP], or", "or 4111.1111.1111.1112 but": None, "or 4111111111111112 but": None, "and 10 . 0 . 3 . 400, or": None, "or 12345678901 ok": None}
    new = spark.createDataFrame(list(enumerate(cases)), docs.schema)
    assert {r["text"] for r in redact(new, judge).collect()} == {v or k for k, v in cases.items()}


def test_query(spark):
    got = op10_personal_data(spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(text)
    for r in got:
        want = brute(text[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for a, _, k, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w[2] == k for w in want) for k in KINDS]
