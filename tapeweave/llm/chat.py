"""Chat formatting by schema fingerprints; expressions only.

A record's nested field paths that hold a value (`messages[].role`, `prompt`, ...) and that some
mapping declares are sorted and hashed. The hash selects one of the declared mappings, which turns the
layout into canonical turns of role and text; other fields (`source`, `messages[].name`) don't count.
Layouts that no mapping declares give no turns and the layout `unknown`, with the hash of all paths
that they hold; so do records that hold other fields alone, and lists of turns without any text
whose elements hold other fields. They stay rows of their own, without turns.

Template: `<|turn|>role<|text|>text<|end|>` and a newline for each turn. Inside roles and texts a
backslash goes before every backslash and into every control string (`<|`, `<s>`, `</s>`, `[INST]`,
`[/INST]`, `<<SYS>>`, `<</SYS>>`), so none of these can be forged, and taking it out restores the
text exactly. The loss mask is a list of code point spans (end exclusive): the texts of `assistant`.

Turns of one conversation are ordered by turn, role and text; repeated rows are repeated turns. Null
text or role: empty. A null conv_id is a conversation of its own. Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = r"(?=\\)|(?<=<)(?=\||/?s>|</?SYS>>)|(?<=\[)(?=/?INST\])"
_TURNS = "array<struct<turn:long,role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


# --- schema fingerprints -------------------------------------------------------------------------


def fingerprint_of(paths) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def leaf_paths(schema: T.StructType, ignore: tuple[str, ...] = ()) -> dict[str, Column]:
    """Every leaf path of a schema and whether a record holds a value there."""
    found: dict[str, Column] = {}

    def walk(kind: T.DataType, path: str, has) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, lambda test, n=f.name: has(lambda c: test(c[n])))
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]", lambda test: has(lambda c: F.coalesce(F.exists(c, lambda x: test(x)), F.lit(False))))
        else:
            found[path] = has(lambda c: c.isNotNull())

    for f in schema.fields:
        if f.name not in ignore:
            walk(f.dataType, f.name, lambda test, n=f.name: test(F.col(f"`{n}`")))
    return found


def fingerprint(schema: T.StructType, ignore: tuple[str, ...] = (), only=None) -> Column:
    """The hash of the sorted field paths that a record holds, of `only` these where given."""
    paths = {p: has for p, has in leaf_paths(schema, ignore).items() if only is None or p in only}
    held = F.array_compact(F.array(*(F.when(paths[p], F.lit(p)) for p in sorted(paths))).cast("array<string>"))
    return F.substring(F.sha2(F.array_join(held, "\n"), 256), 1, 16)


# --- declared mappings ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """`needs` paths a layout always holds, `may` some that can be missing.

    turns: (role or path of the role, path of the text) of each turn; `each`: the array whose elements
    are turns instead.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    order: str = ""
    roles: dict = field(default_factory=dict, hash=False)

    def fingerprints(self):
        some = chain.from_iterable(combinations(self.may, n) for n in range(len(self.may) + 1))
        return [fingerprint_of([*self.needs, *extra]) for extra in some]

    def build(self, schema: T.StructType) -> Column:
        """The canonical turns, for records of `schema`."""
        names = set(schema.fieldNames())
        if self.each:
            role, text = self.turns[0]
            made = F.transform(F.col(self.each), lambda m, i: F.struct(i.cast("long").alias("turn"), self._role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
            return made.cast(_TURNS)
        out = []
        for k, (role, text) in enumerate(self.turns):
            who = self._role(F.col(role[1:])) if role.startswith("$") else F.lit(role)
            said = F.col(text).cast("string") if text in names else F.lit(None).cast("string")
            at = F.col(self.order).cast("long") if self.order in names else F.lit(k).cast("long")
            turn = F.struct(at.alias("turn"), who.alias("role"), F.coalesce(said, F.lit("")).alias("text"))
            # a part that is declared optional and missing makes no turn
            out.append(F.when(said.isNotNull(), turn) if text in self.may and not role.startswith("$") else turn)
        return F.array_compact(F.array(*out)).cast(_TURNS)

    def _role(self, role: Column) -> Column:
        out = F.coalesce(role.cast("string"), F.lit(""))
        for theirs, ours in self.roles.items():
            out = F.when(role == theirs, F.lit(ours)).otherwise(out)
        return out


_SHARED = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turn rows", (), ("turn", "role", "text"), (("$role", "text"),), order="turn"),
    Mapping("prompt", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), ("system", "input"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question", ("question", "answer"), ("context",), (("system", "context"), ("user", "question"), ("assistant", "answer"))),
    Mapping("messages", ("messages[].role",), ("messages[].content",), (("role", "content"),), "messages", roles=_SHARED),
    Mapping("conversations", ("conversations[].from",), ("conversations[].value",), (("from", "value"),), "conversations", roles=_SHARED),
)


def canonical(records: DataFrame, key: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """`key`, layout, fingerprint, turns of every record, whatever its layout."""
    schema = records.schema
    names = leaf_paths(schema, (key,))
    declared = {p for m in mappings for p in (*m.needs, *m.may)}
    rows = records.withColumns({"_f": fingerprint(schema, (key,), declared), "_all": fingerprint(schema, (key,))})
    layout, turns = F.lit("unknown"), F.array().cast(_TURNS)
    for m in mappings:
        usable = all(p in names for p in m.needs) and any(p in names for p in (*m.needs, *m.may))
        if m.each:  # texts of a list of turns are read from its elements
            usable = usable and f"{m.each}[].{m.turns[0][1]}" in names
        if usable:
            mine = F.col("_f").isin(*m.fingerprints()) & ~_elsewhere(m, names, declared)
            layout, turns = F.when(mine, m.name).otherwise(layout), F.when(mine, m.build(schema)).otherwise(turns)
    shown = F.when(layout == "unknown", F.col("_all")).otherwise(F.col("_f"))
    return rows.select(F.col(key), layout.alias("layout"), shown.alias("fingerprint"), turns.alias("turns"))


def _elsewhere(m: Mapping, names: dict[str, Column], declared: set[str]) -> Column:
    """Whether a record holds nothing that `m` reads as text but fields that no mapping declares."""
    none = F.lit(False)
    other = [has for p, has in names.items() if p not in declared and p.startswith(f"{m.each}[]." if m.each else "")]
    read = [f"{m.each}[].{m.turns[0][1]}"] if m.each else [p for p in (*m.needs, *m.may) if p in names]
    return reduce(Column.__or__, other, none) & ~reduce(Column.__or__, [names[p] for p in read], none)


def conversations(records: DataFrame, key: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """One row a conversation: `key`, its ordered turns, from one or more records, and `unknown_layout`.

    `unknown_layout` is null but for records of an unknown layout: each is a row of its own without turns,
    with its fingerprint there.
    """
    alone = F.col("layout") == "unknown"
    rows = canonical(records, key, mappings).withColumns({"_alone": F.when(alone, F.monotonically_increasing_id()), "unknown_layout": F.when(alone, F.col("fingerprint"))})
    return rows.groupBy(key, "_alone").agg(F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"), F.first("unknown_layout").alias("unknown_layout")).drop("_alone")


# --- the template --------------------------------------------------------------------------------


def formatted(convs: DataFrame) -> DataFrame:
    """`convs` (..., turns) with `formatted` and `loss_spans` in place of turns."""
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    rows = convs.withColumn("_parts", parts)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct((stop + len(END) + 1).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("_parts", zero, step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return rows.withColumns({"formatted": text, "loss_spans": spans}).drop("turns", "_parts")


def parsed(rows: DataFrame) -> DataFrame:
    """Reads `formatted` and `loss_spans` back: adds turns (role, text, loss), unescaped.

    Rows of an unknown layout hold no conversation to read and are left out.
    """
    if "unknown_layout" in rows.columns:
        rows = rows.where("unknown_layout is null").drop("unknown_layout")
    pieces = F.split("formatted", r"<\|(?:turn|text|end)\|>", -1)
    cut = rows.withColumn("_p", pieces)
    # pieces: "", then role, text and newline of each turn
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    mark = len(TURN) + len(TEXT) + len(END)

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + len(TURN) + F.length(F.get("_p", 3 * i + 1)) + len(TEXT)
        return F.struct((acc["at"] + mark + F.length(F.get("_p", 3 * i + 1)) + F.length(F.get("_p", 3 * i + 2)) + 1).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    count = F.floor(F.size("_p") / 3).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    cut = cut.withColumn("_starts", F.aggregate(numbers, zero, step, lambda acc: acc["starts"]))
    turn = lambda s, i: F.struct(unescape(F.get("_p", 3 * i + 1)).alias("role"), unescape(F.get("_p", 3 * i + 2)).alias("text"), F.exists("loss_spans", lambda x: (x["start"] == s) & (x["stop"] == s + F.length(F.get("_p", 3 * i + 2)))).alias("loss"))
    return cut.withColumn("turns", F.transform("_starts", turn)).drop("_p", "_starts")


def op7_schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    both = rows.unionByName(extra.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema)))
    out = parsed(formatted(conversations(both)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
