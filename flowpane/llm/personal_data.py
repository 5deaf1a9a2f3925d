"""Personal data: base rules, and candidates judged by boosted trees. DataFrame functions only; nothing runs in Python.

Base rules find emails, IP addresses, card numbers and phone numbers. Beside them, high-recall generators propose spans that
may overlap: addresses with written-out signs, runs of digits with any separators, dotted numbers with blanks. Gradient
boosted trees judge a proposal by its format and its context. Positive are base spans written out in another form (signs in words,
other separators, no plus) within their own context, as far as a generator finds them; negative are proposals that touch no
base span, but for those that are valid and have the signs or the context of their kind, which are left unlabelled. Trees are
fitted on a bounded sample of documents; a threshold per kind is calibrated on the proposals of all other documents, at a
precision of ``PRECISION``. Proposals that reach it, are valid for their kind whatever the separators, and touch no base span
are added; of added spans that touch, the first stays.

Matches are found by putting marks around them, so positions are code points. The patterns are linear: they start at the head
of a run and never give back. Defined results: a null or empty text has no spans, base_sha256 that of the empty string and
spans empty; a null doc_id is kept; repeated rows give repeated results; an empty table gives an empty result. Only doc_id and
text are read; ``redact`` keeps all other columns as they are.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpane.llm.common import stage, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: As the rules read, with runs that are entered at their head only and not given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\[dot\]|\(dot\))\x20?|\x20\.\x20|\x20?\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]++(?:\x20?[.]\x20?[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){7,}+",
    "phone": r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20()./-]{0,3}[0-9]){6,}+",
}
CONTEXT_WORDS = r"(?i)mail|phone|tel|call|card|visa|pay|addr|host|server|\bip\b|contact"
#: Documents whose proposals are fitted, in expectation.
TRAIN_DOCS = 20_000
#: The largest part of the documents that is fitted; the others calibrate.
FITTED = 0.8
TREES, DEPTH = 8, 3
PRECISION = 0.99
FEATURES = ("kind", "length", "digits", "letters", "blanks", "dots", "dashes", "bracket", "luhn", "largest", "before_letter",
            "before_digit", "after_letter", "after_digit", "near_digits", "named")
_OPEN, _CLOSE, _OTHER = chr(1), chr(2), chr(3)
_BLOCK = 64
#: Other forms in which base spans are written out for the fit: signs of an address, separators of numbers.
AT, DOT = (" [at] ", "[at]", " (at) ", "(at)", " @ "), (" [dot] ", "[dot]", "(dot)", ".")
IP_SIGNS, CARD_SIGNS, PHONE_SIGNS = (" . ", ". ", " ."), (".", "/", "  ", ". "), ("-", ".", " ", "/")
#: Characters of context on either side.
_NEAR = 24


def running(lens: Column) -> Column:
    """Sums of the numbers before each, over blocks, so that long arrays take no quadratic time."""
    n = F.size(lens)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / _BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(lens, b * _BLOCK + 1, _BLOCK))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    sums = F.transform(blocks, total)
    starts = F.transform(sums, lambda _, b: total(F.slice(sums, 1, b)))
    return F.flatten(F.zip_with(blocks, starts, lambda xs, s: F.transform(xs, lambda _, i: s + total(F.slice(xs, 1, i)))))


def matches(text: Column, pattern: str) -> Column:
    """(start, end, found) of the leftmost matches that do not overlap, as an array."""
    clean = F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN)
    lens = F.transform(parts, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))
    ends = running(lens)
    spans = F.zip_with(parts, ends, lambda p, s: F.struct(s.alias("start"), (s + F.length(F.substring_index(p, _CLOSE, 1))).cast("int").alias("end"),
                                                          F.substring_index(p, _CLOSE, 1).alias("found")))
    return F.when(F.size(parts) > 1, F.slice(spans, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(F.slice(spans, 1, 0))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    worth = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(
        (n - i) % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0)) + 1))
        .otherwise(F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))))
    return (n > 0) & (F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":  # leading zeros do not count
        return F.forall(F.split(found, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(found)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def _valid_loosely(kind: str, found: Column) -> Column:
    """Whether a proposal is valid for its kind whatever its separators."""
    return _valid(kind, F.regexp_replace(found, r"[^0-9.]", "") if kind == "ip" else found)


#: What a text must hold to be searched for a kind at all.
_HINT = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}
_SPAN = "array<struct<start:int,no:int,kind:string,end:int>>"
_MAYBE = "array<struct<start:int,no:int,kind:string,end:int,found:string,ok:boolean>>"


def _base_of(text: Column, kind: str) -> Column:
    valid = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["found"]))
    spans = F.transform(valid, lambda m: F.struct(m["start"], F.lit(KINDS.index(kind)).alias("no"), F.lit(kind).alias("kind"), m["end"]))
    return F.when(_HINT[kind](text), spans).otherwise(F.array().cast(_SPAN))


def _proposals_of(text: Column, kind: str) -> Column:
    spans = F.transform(matches(text, GENERATORS[kind]), lambda m: F.struct(
        m["start"], F.lit(KINDS.index(kind)).alias("no"), F.lit(kind).alias("kind"), m["end"], m["found"],
        _valid_loosely(kind, m["found"]).alias("ok")))
    hint = text.contains("@") | text.contains("at]") | text.contains("at)") if kind == "email" else text.rlike("[0-9]")
    return F.when(hint, spans).otherwise(F.array().cast(_MAYBE))


def found_in(docs: DataFrame) -> DataFrame:
    """``docs`` with __text, the base spans of each kind and the proposals that touch none of them."""
    rows = docs.withColumn("__text", text_or_empty())
    text = F.col("__text")
    rows = rows.withColumns({f"__{k}": _base_of(text, k) for k in KINDS})
    return rows.withColumns({"__base": F.array_sort(F.concat(*[F.col(f"__{k}") for k in KINDS])),
                             "__maybe": F.concat(*[_proposals_of(text, k) for k in KINDS])})


def _features(text: Column, m: Column) -> dict[str, Column]:
    found, start, end = m["found"], m["start"], m["end"]
    count = lambda chars: (F.length(found) - F.length(F.translate(found, chars, ""))).cast("double")
    one = lambda c: c.cast("double")
    before, after = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(""), F.substring(text, end + 1, F.lit(1))
    near = F.concat(F.substring(text, F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24))), F.lit(" "), F.substring(text, end + 1, F.lit(24)))
    digits = _digits(found)
    largest = F.array_max(F.transform(F.split(found, "[^0-9]+"), lambda p: F.when(F.length(p) > 4, 9999).otherwise(F.coalesce(p.try_cast("int"), F.lit(0)))))
    return {
        "kind": one(m["no"]), "length": one(F.length(found)), "digits": one(F.length(digits)),
        "letters": one(F.length(F.regexp_replace(found, "[^A-Za-z]", ""))), "blanks": count(" "), "dots": count("."), "dashes": count("-"),
        "bracket": count("(["), "luhn": one(_luhn(digits)), "largest": one(largest),
        "before_letter": one(before.rlike("[A-Za-z]")), "before_digit": one(before.rlike("[0-9]")), "after_letter": one(after.rlike("[A-Za-z]")),
        "after_digit": one(after.rlike("[0-9]")), "near_digits": one(F.length(F.regexp_replace(near, "[^0-9]", ""))), "named": one(near.rlike(CONTEXT_WORDS))}


def _tree(node, names, row: Column) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(row[names[split.featureIndex()]] <= float(split.threshold()), _tree(node.leftChild(), names, row)).otherwise(_tree(node.rightChild(), names, row))


def _free(maybe: Column, base: Column) -> Column:
    """The proposals that touch no base span."""
    return F.filter(maybe, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))


def _written_out(no: Column, found: Column, v: Column) -> Column:
    """A base span in another form, chosen by the number ``v``."""
    one = lambda signs, x: F.element_at(F.array(*[F.lit(c) for c in signs]), (F.pmod(x, F.lit(len(signs))) + 1).cast("int"))
    email = F.concat(F.substring_index(found, "@", 1), one(AT, v), F.replace(F.substring_index(found, "@", -1), F.lit("."), one(DOT, F.floor(v / len(AT)))))
    ip = F.replace(found, F.lit("."), one(IP_SIGNS, v))
    card = F.replace(F.regexp_replace(_digits(found), "([0-9]{4})(?=[0-9])", "$1~"), F.lit("~"), one(CARD_SIGNS, v))
    bare = F.substring(found, 2, 1 << 30)
    signs = F.replace(F.regexp_replace(bare, "[^0-9]+", "~"), F.lit("~"), one(PHONE_SIGNS, F.floor(v / 3)))
    phone = F.when(v % 3 == 0, bare).when(v % 3 == 1, signs).otherwise(F.regexp_replace(found, r"^\+[0-9]+[\x20.-]*", ""))
    return F.when(no == 0, email).when(no == 1, ip).when(no == 2, card).otherwise(phone)


def _examples(found: DataFrame, *others: str) -> DataFrame:
    """``FEATURES`` and label of the proposals that touch no base span, and of the base spans written out in another form."""
    text = F.col("__text")

    def around(m: Column, own: Column, ok: Column, label: float) -> Column:
        return F.struct(F.substring(text, F.greatest(m["start"] - (_NEAR - 1), F.lit(1)), F.least(m["start"], F.lit(_NEAR))).alias("left"), own.alias("found"),
                        F.substring(text, m["end"] + 1, F.lit(_NEAR)).alias("right"), m["no"].alias("no"), ok.alias("ok"), F.lit(label).alias("label"))
    base = F.transform("__base", lambda b: around(b, F.substring(text, b["start"] + 1, b["end"] - b["start"]), F.lit(True), 1.0))
    free = F.transform(_free(F.col("__maybe"), F.col("__base")), lambda m: around(m, m["found"], m["ok"], 0.0))
    each = found.select(*others, F.explode(F.concat(base, free)).alias("x")).select(*others, "x.*")
    v = F.pmod(F.xxhash64("left", "found", "right"), F.lit(1_000_003))
    each = each.withColumn("found", F.when(F.col("label") == 1, _written_out(F.col("no"), F.col("found"), v)).otherwise(F.col("found")))
    each = each.withColumn("__text", F.concat("left", "found", "right"))
    start, end = F.length("left"), F.length("left") + F.length("found")
    again = F.lit(False)
    for no, kind in enumerate(KINDS):
        again = F.when(F.col("no") == no, F.exists(_proposals_of(text, kind), lambda m: (m["start"] == start) & (m["end"] == end) & m["ok"])).otherwise(again)
    m = F.struct(start.alias("start"), F.col("no"), end.alias("end"), F.col("found"))
    rows = each.filter((F.col("label") == 0) | again).select(*others, "label", "ok", "found", *[c.alias(k) for k, c in _features(text, m).items()])
    named, kind = F.col("named") > 0, F.col("kind")
    signs = ((kind == 0) & F.col("found").rlike(r"at[\])]")) | (kind == 2)
    bare = (kind == 3) & (F.col("digits") == F.col("length"))
    return rows.filter(F.when(F.col("label") == 1, ~bare | named).otherwise(~(F.col("ok") & (named | signs)))).select(*others, *FEATURES, "label")


class Judge:
    """The trees as one expression, and a threshold per kind (none: nothing of that kind is added)."""

    def __init__(self, model, thresholds: dict[int, float]) -> None:
        self.trees = list(zip(model.treeWeights, [t._call_java("rootNode") for t in model.trees], strict=True)) if model else []
        self.thresholds = thresholds

    def probability(self, row: Column) -> Column:
        margin = F.lit(0.0)
        for weight, root in self.trees:
            margin = margin + float(weight) * _tree(root, FEATURES, row)
        return 1 / (1 + F.exp(-2 * margin))

    def added(self, text: Column, maybe: Column, base: Column) -> Column:
        """The accepted proposals that touch no base span; of those that touch each other, the first."""
        if not self.thresholds:
            return F.slice(base, 1, 0)

        def accepted(m: Column) -> Column:
            c = F.lit(2.0)
            for no, threshold in sorted(self.thresholds.items()):
                c = F.when(m["no"] == no, F.lit(threshold)).otherwise(c)
            row = F.struct(*[v.alias(k) for k, v in _features(text, m).items()])
            return F.exists(F.array(row), lambda r: self.probability(r) >= c)
        taken = F.array_sort(F.transform(F.filter(_free(maybe, base), lambda m: m["ok"] & accepted(m)), lambda m: F.struct(m["start"], m["no"], m["kind"], m["end"])))
        return F.filter(taken, lambda m, i: ~F.exists(F.slice(taken, 1, i), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Judge:
    """Boosted trees over the proposals of about ``train_docs`` documents, and thresholds from those of all others."""
    n = docs.count()
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text_or_empty()), F.lit(1_000_000))
    held = (part >= int(1_000_000 * min(FITTED, train_docs / max(n, 1)))).alias("__held")
    rows = stage(_examples(found_in(docs.select("doc_id", "text", held)), "__held"), "proposals")
    classes = {(r["__held"], r["label"]) for r in rows.groupBy("__held", "label").count().collect()}
    if not {(False, 0.0), (False, 1.0)} <= classes:
        return Judge(None, {})
    fitted = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(rows.filter("NOT __held")).select("__features", "label")
    model = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=11, stepSize=0.3).fit(fitted)
    judge = Judge(model, {})
    scored = rows.filter("__held").select(F.col("kind").cast("int").alias("no"), "label", F.floor(100 * judge.probability(F.struct(*FEATURES))).cast("int").alias("at"))
    # a row for each kind and hundredth at most
    bins = scored.groupBy("no", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")).collect()
    for no in range(len(KINDS)):
        seen = hits = 0
        for r in sorted((r for r in bins if r["no"] == no), key=lambda r: -r["at"]):
            seen, hits = seen + r["n"], hits + r["hits"]
            if hits >= PRECISION * seen and r["at"] >= 50:
                judge.thresholds[no] = r["at"] / 100
    return judge


def personal_data(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``docs`` with __base (spans of the base rules) and __spans (those and the added ones), each by start and kind."""
    judge = judge or train(docs)
    rows = found_in(docs)
    return rows.withColumn("__spans", F.array_sort(F.concat("__base", judge.added(F.col("__text"), F.col("__maybe"), F.col("__base")))))


def redact(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``docs`` with [EMAIL], [IP], [CARD], [PHONE] for every span; n_chars, if there, is that of the new text."""
    spans, text = F.col("__spans"), F.col("__text")
    last = F.transform(spans, lambda _, i: F.coalesce(F.array_max(F.transform(F.slice(spans, 1, i), lambda b: b["end"])), F.lit(0)))
    pieces = F.zip_with(spans, last, lambda s, p: F.when(s["start"] >= p, F.concat(
        F.substring(text, p + 1, s["start"] - p), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
    rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    new = F.when(F.size(spans) == 0, F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    out = personal_data(docs, judge).withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = personal_data(docs)
    return found.select("doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.col("__spans")).alias("spans"))
