"""Personal data by candidate gradient boosting, in DataFrame and Spark ML operations only.

High-recall generators propose spans that may overlap: every match of the base patterns whether or not it
passes its check, long numbers, mixed tokens and quoted or assigned values.  Each candidate gets
features of its format and of the characters around it.  Boosted trees are fitted on one half of all
candidates with programmatic labels (a match that passes the check of its kind, a token or value given to a
credential word, a number of 8 to 15 digits behind a phone or identity word or one that passes the Luhn check), thresholds are calibrated per generator on the other half, and what passes
is redacted next to the base spans.

Positions count code points, ends are exclusive.  Cases: a null or empty text has no spans; very long
texts are read whole, and no pattern can run back over what it has read; null ids keep their row;
repeated rows get the same spans; an empty table gives an empty result; spans that start together are ordered
by kind; further columns of any name are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, stored, unit_hash

TREES, DEPTH, PRECISION = 12, 3, 0.98
AROUND = 24

#: The base kinds in their order.  Quantifiers are possessive where nothing behind them could
#: give characters back, and a run is entered at its start or where the last match ended, so that
#: matching is linear; the matches are those of the contract's patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of the hint has none of the pattern either; elsewhere the pattern is its own hint.
#: Matches per block of running sums.
BLOCK = 128

HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "phone": r"\+[0-9]"}
#: In a text, card matches that can pass are those of 16 to 19 digits; other matches are left out before they
#: are listed.  Such a match starts behind no digit and no digit with one separator, and ends alike.
LONG_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])"
#: Further generators, and the kind of what they propose.
GENERATORS = {
    "number": r"(?:\G|(?<![0-9A-Za-z]))[0-9](?:[\x20().-]{0,2}[0-9]){7,18}+(?![0-9A-Za-z])",
    "token": r"(?:\G|(?<![A-Za-z0-9_+/=-]))(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
    "value": r"(?<=[:=][\x20\x09]{0,3}[\"']{0,1}|[\"'])[^\s\"'<>,;()]{4,}+",
}
CREDENTIAL = r"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|auth|bearer)[\"']?\s{0,3}[:=]?\s{0,3}[\"']?$"
#: What stands before a phone or identity number, with its number word and mark.
NUMBERED = r"(?i)(?<![a-z])(?:phone|telephone|tel|mobile|cell|fax|call|contact|ssn|passport|identity|id|tax|licen[cs]e|account)(?:\s(?:no|nr|number|card))?[.:#=]{0,2}\s{0,3}[+(#]?$"
FEATURES = (
    "n_chars", "n_digits", "n_letters", "n_upper", "n_marks", "digit_share", "hex", "luhn", "has_at", "n_dots", "starts_plus",
    "credential", "numbered", "quoted", "assigned", "digit_before", "letter_before", "digit_after", "letter_after", "is_email", "is_ip", "is_card", "is_phone", "is_number", "is_token", "is_value",
)
KINDS = (*BASE, *GENERATORS)


def listed(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds ``candidates``: matches of every pattern as (kind, start, end, match, before, after).

    ``split`` gives what lies between matches, so a start is a running sum of lengths.  Sums run inside
    blocks of matches and over block totals, which keeps texts with very many matches cheap.  Each
    step is a column of its own, so no pattern is matched again inside a later expression.
    """
    text, none = F.col("text"), F.array().cast("array<string>")
    lists, steps, blocks, spans = {}, {}, {}, []
    for kind, pattern in patterns.items():
        present = text.rlike(HINTS.get(kind, pattern))
        lists[f"m_{kind}"] = F.when(present, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
        lists[f"g_{kind}"] = F.when(present, F.split(text, pattern, -1)).otherwise(none)
        m, g = F.col(f"m_{kind}"), F.col(f"g_{kind}")
        zipped = F.arrays_zip(m.alias("m"), g.alias("g"), F.slice(g, 2, F.greatest(F.size(g), F.lit(1))).alias("n"))
        steps[f"x_{kind}"] = F.filter(
            F.transform(zipped, lambda x: F.struct(
                x["m"].alias("m"), (F.length(x["g"]) + F.length(x["m"])).alias("step"), F.length(x["m"]).alias("size"), F.right(x["g"], F.lit(AROUND)).alias("before"), F.left(x["n"], F.lit(2)).alias("after"),
            )), lambda x: x["m"].isNotNull(),
        )
        x = F.col(f"x_{kind}")
        numbers = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(numbers, lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda s, y: s + y["step"]))
        offsets = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.get(a, F.size(a) - 1) + n)))
        blocks[f"b_{kind}"] = F.filter(F.transform(offsets, lambda at, b: F.struct(b.alias("b"), at.alias("at"))), lambda y: y["b"] * BLOCK < F.size(x))
        spans.append(F.flatten(F.transform(f"b_{kind}", _block_of(kind, x))))
    rows = rows.withColumns(lists).select(*rows.columns, *[c for c in lists])
    rows = rows.select("doc_id", "text_hash", *[c.alias(n) for n, c in steps.items()])
    return rows.withColumns(blocks).select("doc_id", "text_hash", F.concat(*spans).alias("candidates"))


def _block_of(kind: str, matches: Column):
    """The spans of one block of matches."""
    shape = "struct<kind:string,start:int,end:int,match:string,before:string,after:string>"

    def span(at: Column, y: Column) -> Column:
        start = at + y["step"] - y["size"]
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (at + y["step"]).alias("end"), y["m"].alias("match"), y["before"], y["after"])

    return lambda block: F.aggregate(
        F.slice(matches, block["b"] * BLOCK + 1, F.lit(BLOCK)), F.struct(block["at"].alias("at"), F.array().cast(f"array<{shape}>").alias("spans")),
        lambda acc, y: F.struct((acc["at"] + y["step"]).alias("at"), F.concat(acc["spans"], F.array(span(acc["at"], y).cast(shape))).alias("spans")),
    )["spans"]


def luhn(match: Column) -> Column:
    """Whether the digits of a short match pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    at = lambda i: F.substring(digits, i + 1, 1).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, F.when(at(i) > 4, 2 * at(i) - 9).otherwise(2 * at(i))).otherwise(at(i))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def n_digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


def passes(x: Column) -> Column:
    """The check of the base kinds."""
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    digits = n_digits(x["match"])
    return (
        F.when(x["kind"] == "email", F.lit(True))
        .when(x["kind"] == "ip", x["match"].rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$"))
        .when(x["kind"] == "card", F.when(digits.between(16, 19), luhn(x["match"])).otherwise(F.lit(False)))
        .when(x["kind"] == "phone", digits.between(8, 15)).otherwise(F.lit(False))
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash, base (spans that pass their check) and candidates (all proposals)."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return listed(rows, {**BASE, "card": LONG_CARD, **GENERATORS}).withColumn("base", F.filter("candidates", passes))


def featured(proposals: DataFrame) -> DataFrame:
    """One row per candidate (columns of the span) with FEATURES and the programmatic label."""
    m, before, after = F.col("match"), F.col("before"), F.col("after")
    count = lambda of: F.length(F.regexp_replace(m, f"[^{of}]", "")).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values = {
        "n_chars": F.length(m).cast("double"), "n_digits": count("0-9"), "n_letters": count("A-Za-z"), "n_upper": count("A-Z"), "n_marks": count(r"\x20().\-"),
        "digit_share": count("0-9") / F.length(m), "hex": flag(m.rlike("^[0-9a-f]+$")), "luhn": flag(F.when(n_digits(m).between(12, 19), luhn(m))),
        "has_at": flag(F.contains(m, F.lit("@"))), "n_dots": count("."), "starts_plus": flag(m.startswith("+")),
        "credential": flag(before.rlike(CREDENTIAL)), "numbered": flag(before.rlike(NUMBERED)), "quoted": flag(before.rlike("[\"']$")), "assigned": flag(before.rlike("[:=]\\s{0,3}[\"']?$")),
        "digit_before": flag(before.rlike("[0-9]\\s?$")), "letter_before": flag(before.rlike("\\p{L}$")),
        "digit_after": flag(after.rlike("^\\s?[0-9]")), "letter_after": flag(after.rlike("^\\p{L}")),
        **{f"is_{k}": flag(F.col("kind") == k) for k in KINDS},
    }
    number = n_digits(m).between(8, 15) & before.rlike(NUMBERED) | F.when(n_digits(m).between(12, 19), luhn(m)).otherwise(F.lit(False))
    given = F.col("kind").isin("token", "value") & before.rlike(CREDENTIAL)
    label = (F.col("passed") | given | (F.col("kind") == "number") & number).cast("double")
    return proposals.withColumns(values).withColumn("label", label)


def exploded(found_: DataFrame) -> DataFrame:
    return found_.select("doc_id", "text_hash", F.explode("candidates").alias("c")).select("doc_id", "text_hash", "c.*", passes(F.col("c")).alias("passed")).dropDuplicates(
        ["doc_id", "text_hash", "kind", "start"]
    )


def fitted(known: DataFrame):
    """(model, thresholds by kind) from half of the candidates each; None without both labels."""
    known = known.withColumn("__held", unit_hash("match", "before", seed=3) < 0.5)
    n = known.groupBy("__held").agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("all")).collect()
    if len(n) < 2 or any(r["yes"] in (0, r["all"]) for r in n):
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, labelCol="label", cacheNodeIds=False).fit(vectors.transform(known.filter(~F.col("__held"))))
    scored = model.transform(vectors.transform(known.filter("__held"))).select("kind", "label", F.round(vector_to_array("probability")[1], 2).alias("p"))
    bins = scored.groupBy("kind", "p").agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("all")).collect()
    thresholds = {}
    for kind in KINDS:
        yes = every = 0
        for p, y, a in sorted(((r["p"], r["yes"], r["all"]) for r in bins if r["kind"] == kind), reverse=True):
            yes, every = yes + y, every + a
            if p >= 0.5 and yes >= PRECISION * every:
                thresholds[kind] = p
    return model, thresholds


def detect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), base and spans: arrays of (kind, start, end) in order of kind, then start.
    ``spans`` holds the base and what the trees select."""
    folder = shared_folder(docs.sparkSession)
    proposed = stored(candidates(docs, id_column, text_column), folder, "candidates")
    known = stored(featured(exploded(proposed)), folder, "features")
    learned = fitted(known)
    order = F.array(*[F.lit(k) for k in KINDS])
    short = lambda x: F.struct(F.array_position(order, x["kind"]).alias("place"), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.transform("base", short)
    out = proposed.select("doc_id", "text_hash", base.alias("base"))
    if learned is None or not learned[1]:
        return out.select("doc_id", "text_hash", "base", F.col("base").alias("spans"))
    model, thresholds = learned
    limit = F.lit(2.0)
    for kind, p in thresholds.items():
        limit = F.when(F.col("kind") == kind, F.lit(p)).otherwise(limit)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    selected = (
        model.transform(vectors.transform(known)).filter(F.round(vector_to_array("probability")[1], 2) >= limit)
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))  # no larger than one document
        .agg(F.collect_list(F.struct(F.array_position(order, F.col("kind")).alias("place"), "kind", "start", "end")).alias("more"))
    )
    return out.join(selected, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").select(
        "doc_id", "text_hash", "base", F.array_sort(F.array_union("base", F.coalesce("more", F.slice("base", 1, 0)))).alias("spans")
    )


def counted(detected: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text)."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return detected.select("doc_id", *[n(k) for k in BASE], F.sha2(joined(F.array_sort("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, detected: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text), a row for each row of ``docs``, with every detected stretch of that text replaced by the kind of
    the span that starts first, in brackets.  Rows that share an id, or have none, are told apart by their texts."""
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], (-x["end"]).alias("back"), x["kind"])))
    one = detected.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), ordered.alias("__spans"))
    rows = docs.select(F.col(id_column), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("__text"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walk = F.aggregate("__spans", start, lambda a, x: F.struct(
        F.greatest(a["at"], -x["back"]).alias("at"),
        F.when(x["start"] >= a["at"], F.concat(a["out"], F.substr("__text", a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(a["out"]).alias("out"),
    ))
    return rows.join(one, F.col(id_column).eqNullSafe(F.col("__id")) & (F.xxhash64("__text") == F.col("__hash")), "left").select(
        id_column, F.when(F.col("__spans").isNull(), F.col("__text")).otherwise(F.concat(walk["out"], F.substr("__text", walk["at"] + 1, F.lit(2**31 - 1)))).alias(text_column)
    )
