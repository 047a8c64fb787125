"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose candidate spans. Four labelers vote on each (for, against or no opinion): the strict
form of its kind, gazetteers (top-level domains, card prefixes, address blocks, calling codes,
honorifics), cue words in the text before it, and the characters around it. Votes are counted by kind
and pattern of votes (a few hundred rows); expectation-maximisation on those counts estimates how
reliable each labeler is and how likely each pattern is to be personal data. Those posteriors then
weigh the counts of span features (votes, shape, word before, length) from which a naive Bayes
classifier is trained, and it judges every span.

Base spans (email, ip, card, phone by their contract patterns and checks) always stay. Spans of other
kinds are added where the classifier gives at least THRESHOLD and they overlap no base span.

Positions count code points, ends are exclusive. Null or empty text: no spans. Repeated rows are
searched each. All other columns are kept; a column of the name `spans` is replaced. No candidates in
training: nothing is added.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Kinds in the order of ties, base kinds first, and the patterns that propose them.
# Possessive runs and the look-behinds (or the end of the last match) only save retries.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "name", "card_part", "phone_part")
BASE = KINDS[:4]
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}+(?: [A-Z][a-z]{1,30}+)?(?![A-Za-z])",
    "card_part": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    "phone_part": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "phone": r"\+[0-9]", "name": r"(?:Mr|Mrs|Ms|Dr|Prof)\. "}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)++[A-Za-z]{2,24}$",
    "ip": r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{4}[ -]?){3}[0-9]{2,7}$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{2,4}[ .-]?[0-9]{2,6}$",
    "secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|ghp|AKIA)[A-Za-z0-9_-]{16,})$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "name": r" [A-Z][a-z]+ [A-Z][a-z]+$",
    "card_part": r"^[3-6][0-9]{12,18}$",
    "phone_part": r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}$",
}
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|us|ca|it|nl|ch|at)$",
    "ip": r"^(?!0\.|127\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-58])",
    "secret": r"^(?:sk_|pk_|ghp_|AKIA)",
    "name": r"^(?:Mr|Mrs|Ms|Dr|Prof)\. ",
    "card_part": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|from|to)\W{0,6}$",
    "ip": r"(?i)(?:\bip|host|server|address|addr|client|from)\W{0,6}$",
    "card": r"(?i)(?:card|visa|master|amex|payment|account)\W{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|contact|cell)\W{0,8}$",
    "secret": r"(?i)(?:token|secret|key|password|passwd|credential|bearer)[\s\"'=:>-]{1,8}$",
    "ssn": r"(?i)(?:ssn|social security|tax id)\D{0,12}$",
    "name": r"(?i)(?:by|from|with|signed|contact|dear)\W{0,4}$",
    "card_part": r"(?i)(?:card|visa|master|amex|payment|account)\W{0,12}$|[0-9]{13,19} $",
    "phone_part": r"(?i)(?:phone|tel|call|mobile|fax|contact|cell)\W{0,8}$",
}
AGAINST = r"(?i)(?:version|isbn|section|commit|sha|checksum|part no|order|revision|\bv)\W{0,4}$"

THRESHOLD = 0.9
HASHES = 256
ROUNDS = 60


def _found(text: Column, kind: str) -> tuple[Column, Column]:
    """All matches of a kind in a text, and the stretches between them."""
    pattern = PATTERNS[kind]
    tried = text.rlike(_NEEDS.get(kind, "[0-9]"))
    return F.when(tried, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.when(tried, F.split(text, pattern, -1))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the check sum."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _passes(kind: str, match: Column) -> Column:
    """The checks of the contract, for kinds that have some."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind in ("card", "card_part"):
        return F.when(n.between(14 if kind == "card" else 13, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _candidate(rank: int, between: Column, starts: Column):
    def made(x: Column, i: Column) -> Column:
        start = F.get(starts, i)
        around = F.right(F.get(between, i), F.lit(40)).alias("before"), F.left(F.get(between, i + 1), F.lit(1)).alias("after")
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x)).alias("stop"), x.alias("match"), *around)

    return made


def _passing(kind: str):
    return lambda c: _passes(kind, c["match"])


def with_candidates(docs: DataFrame) -> DataFrame:
    """`docs` with `_c`: all candidates of `text` that pass the checks of their kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs
    for kind in KINDS:
        matches, between = _found(text, kind)
        raw = raw.withColumns({f"_m_{kind}": matches, f"_p_{kind}": between})
    for kind in KINDS:
        m, p = F.col(f"_m_{kind}"), F.col(f"_p_{kind}")
        # running length of stretches and matches, so that each match knows its start
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda acc, x: F.struct((acc["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + F.length(x["p"]))).alias("starts"))
        starts = F.when(F.size(m) > 0, F.aggregate(F.arrays_zip(p.alias("p"), m.alias("m")), zero, step, lambda acc: acc["starts"]))
        raw = raw.withColumn(f"_s_{kind}", starts)
    parts = []
    for rank, kind in enumerate(KINDS):
        m, p, s = F.col(f"_m_{kind}"), F.col(f"_p_{kind}"), F.col(f"_s_{kind}")
        made = F.transform(m, _candidate(rank, p, s))
        passed = F.filter(made, _passing(kind))
        parts.append(F.when(F.size(m) > 0, passed).otherwise(F.array().cast("array<struct<start:int,rank:int,stop:int,match:string,before:string,after:string>>")))
    out = raw.withColumn("_c", F.concat(*parts))
    return out.drop(*(f"_{x}_{kind}" for x in "mps" for kind in KINDS))


def _by_kind(rank: Column, tests: dict[str, str], value: Column, yes: int, no: int) -> Column:
    """`yes` where the value matches its kind's pattern, `no` where not; 0 for kinds without one."""
    out = F.lit(0)
    for i, kind in enumerate(KINDS):
        if kind in tests:
            out = F.when(rank == i, F.when(value.rlike(tests[kind]), yes).otherwise(no)).otherwise(out)
    return out


def votes(c: Column) -> list[Column]:
    """-1, 0 or 1 of each labeler on a candidate."""
    rank, match, before, after = c["rank"], c["match"], c["before"], c["after"]
    context = F.when(before.rlike(AGAINST), -1).otherwise(_by_kind(rank, CUES, before, 1, 0))
    around = F.when(before.rlike(r"[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]"), -1).otherwise(1)
    return [_by_kind(rank, STRICT, match, 1, -1), _by_kind(rank, GAZETTEER, match, 1, -1), context, around]


def _pattern_number(c: Column) -> Column:
    number = c["rank"]
    for v in votes(c):
        number = number * 3 + v + 1
    return number


def _features(c: Column) -> list[Column]:
    """Numbers of the features of a candidate: votes and kind, shape, word before, length."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(c["match"], "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    word = F.lower(F.regexp_extract(c["before"], r"([A-Za-z]{1,20})[^A-Za-z]*$", 1))
    hashed = lambda x: F.pmod(F.xxhash64(c["rank"], x), F.lit(HASHES)).cast("int")
    return [_pattern_number(c), hashed(shape), hashed(word), c["rank"] * 32 + F.least(F.floor(F.length(c["match"]) / 2).cast("int"), F.lit(31))]


_SIZES = (len(KINDS) * 81, HASHES, HASHES, len(KINDS) * 32)


def estimate(counts: dict[int, int]) -> dict[int, float]:
    """Expectation-maximisation: the probability of personal data for each kind and pattern of votes."""
    rows = []
    for number, n in counts.items():
        kind, rest = divmod(number, 81)
        rows.append((number, kind, [rest // 3 ** (3 - j) % 3 for j in range(4)], n))
    sure = {number: 1 / (1 + math.exp(-1.5 * sum(v - 1 for v in vs))) for number, _, vs, _ in rows}
    for _ in range(ROUNDS):
        total = {(kind, y): 1.0 for kind, y in product(range(len(KINDS)), (0, 1))}
        table = {(j, v, y): 1.0 for j, v, y in product(range(4), range(3), (0, 1))}
        # a labeler is held to do better than chance, else the two classes could change places
        table |= {(j, v, y): 5.0 for j, v, y in ((j, 2 * y, y) for j in range(4) for y in (0, 1))}
        for number, kind, vs, n in rows:
            for y, p in ((1, sure[number]), (0, 1 - sure[number])):
                total[kind, y] += n * p
                for j, v in enumerate(vs):
                    table[j, v, y] += n * p
        mass = {(j, y): sum(table[j, v, y] for v in range(3)) for j, y in product(range(4), (0, 1))}
        for number, kind, vs, _ in rows:
            odds = math.log(total[kind, 1] / total[kind, 0]) + sum(math.log(table[j, v, 1] / mass[j, 1]) - math.log(table[j, v, 0] / mass[j, 0]) for j, v in enumerate(vs))
            sure[number] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return sure


def train(docs: DataFrame) -> list[list[float]]:
    """Log-odds of each feature's values, the prior first; fitted on all candidates of `docs`."""
    found = with_candidates(docs.select("text")).where(F.size("_c") > 0).select(F.explode("_c").alias("c"))
    numbers = found.select(*(f.alias(f"f{i}") for i, f in enumerate(_features(F.col("c")))))
    # four numbers below fixed bounds a candidate: all that the training needs
    numbers = common.stored(numbers.groupBy("f0", "f1", "f2", "f3").count(), "candidates")
    counts = {r["f0"]: r["n"] for r in numbers.groupBy("f0").agg(F.sum("count").alias("n")).collect()}
    sure = estimate(counts)
    weight = F.element_at(F.array(*(F.lit(float(sure.get(i, 0.5))) for i in range(_SIZES[0]))), F.col("f0") + 1)
    weighed = numbers.select("f0", "f1", "f2", "f3", (weight * F.col("count")).alias("yes"), ((1 - weight) * F.col("count")).alias("no"))
    model = []
    yes_all = sum(sure[k] * n for k, n in counts.items())
    no_all = sum(counts.values()) - yes_all
    prior = math.log((yes_all + 1) / (no_all + 1))
    for i, size in enumerate(_SIZES):
        table = [0.0] * size
        for value, yes, no in weighed.groupBy(f"f{i}").agg(F.sum("yes"), F.sum("no")).collect():
            table[value] = math.log((yes + 0.5) / (yes_all + 0.5 * size)) - math.log((no + 0.5) / (no_all + 0.5 * size))
        model.append(table)
    return [[prior], *model]


def with_spans(docs: DataFrame, model: list[list[float]]) -> DataFrame:
    """`docs` with `spans`: array of (start, rank, stop, kind, text, probability, base), by start and kind."""
    plain, back = common.apart(docs.drop("spans"), "text")
    return back(_with_spans(plain, model), "spans")


def _with_spans(docs: DataFrame, model: list[list[float]]) -> DataFrame:
    kind = F.array(*(F.lit(k) for k in KINDS))
    (prior,), *tables = model

    def judged(c: Column) -> Column:
        odds = F.lit(prior)
        for f, table in zip(_features(c), tables, strict=True):
            odds = odds + F.element_at(F.array(*(F.lit(float(x)) for x in table)), f + 1)
        p = 1 / (1 + F.exp(-odds))
        return F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["stop"].alias("stop"), F.element_at(kind, c["rank"] + 1).alias("kind"), c["match"].alias("text"), p.alias("probability"), (c["rank"] < len(BASE)).alias("base"))

    none = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string,text:string,probability:double,base:boolean>>")
    rows = with_candidates(docs).withColumn("_j", F.when(F.size("_c") > 0, F.transform("_c", judged)).otherwise(none))
    base = F.filter("_j", lambda s: s["base"])
    more = F.filter("_j", lambda s: ~s["base"] & (s["probability"] >= THRESHOLD))
    rows = rows.withColumns({"_b": base, "_x": more})
    free = F.filter("_x", lambda s: ~F.exists("_b", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return rows.withColumn("spans", F.array_sort(F.concat("_b", free))).drop("_c", "_j", "_b", "_x")


def redacted(docs: DataFrame, model: list[list[float]]) -> DataFrame:
    """`docs` with each span in `text` replaced by its kind in brackets; n_chars follows if present."""
    docs, back = common.apart(docs, "text", "n_chars")
    text = F.coalesce(F.col("text"), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        tag = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), tag)
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], put).otherwise(acc["out"]).alias("out"))

    rows = _with_spans(docs, model).withColumn("_t", F.aggregate("spans", zero, step))
    clean = F.when(F.size("spans") > 0, F.concat(F.col("_t.out"), F.substring(text, F.col("_t.at") + 1, F.length(text)))).otherwise(F.col("text"))
    rows = rows.withColumn("text", clean)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return back(rows)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op1_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_spans(docs, train(docs))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
