"""Operator 4, PII by bootstrapped contextual extraction, in SQL functions only.

Base: four patterns (email, ip, card, phone) with their checks give the seed
entities and their spans. Every identifier-like run of a text (it has a digit
or an ``@``) is an instance; the words left and right of it are its lexical
patterns. Spark then scores the bipartite graph of patterns and instances in
``rounds`` rounds: a pattern's confidence for a kind is the mean score of its
distinct instances (one doubt added), and an instance's score is that of its
best accepted pattern, seeds staying at 1. Patterns of at least
``min_support`` scored instances and ``min_confidence`` are accepted. Instances that no base
span touches and that accepted patterns score highly enough are added as spans
of their kind.

The graph has a row for each pattern and distinct instance (sums made before
the shuffle); a pattern or value as frequent as any word is a hot key only of joins
with written tables, which AQE splits.

Spans are code points, end exclusive. They come from what ``split`` leaves
between the matches, so each pattern is matched twice and no text is moved; the
work on a text grows in proportion to it, however many matches it has.
Atomic groups keep the matching linear; where a greedy loop could never give
back characters with success, they match the same. An email may start only
where a run of its characters starts or the last match ended.

Defined results: a null or empty text has no spans; rows of equal id and text
get equal results, one each; an empty table gives none. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkflow.llm.common import small, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What an identifier-like run is: a word with a digit or @, and the groups of digits after it.
RUN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[(]?+[0-9]\S*+)*+"
#: Items of an array that are appended to at once; characters of a block that a part of a text is taken from.
SCANNED, BLOCK = 128, 4096
#: Bytes of a span in an array of Spark's rows: its place, null bits and three fields.
SPAN_BYTES = 40
SPAN = "array<struct<kind:int,start:int,end:int>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(number)
    at = F.sequence(F.lit(1), n)
    digit = lambda i: F.substring(number, i, F.lit(1)).cast("int")
    twice = lambda i: digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, twice(i)).otherwise(digit(i)))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits(match))).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once (lambdas evaluate what they name each time)."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, element: str, step) -> Column:
    """struct(at, out): ``step(at, item)`` gives the next ``at`` (from 0) and an
    array of ``element`` to append. Arrays are appended to in slices of SCANNED
    items and then slice by slice, as each append copies the array."""
    empty = lambda kind: F.array().cast(f"array<{kind}>")

    def inner(acc, x):
        to, more = step(acc["at"], x)
        return F.struct(to.alias("at"), F.concat(acc["out"], more).alias("out"))

    def outer(acc, part):
        own = F.aggregate(part, F.struct(acc["at"].alias("at"), empty(element).alias("out")), inner)
        return bind(own, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    def whole(all_items):
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_items), F.lit(1)), F.lit(SCANNED))
        parts = F.transform(starts, lambda i: F.slice(all_items, i, F.lit(SCANNED)))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty(f"array<{element}>").alias("outs")), outer)

    return bind(bind(items, whole), lambda r: F.struct(r["at"].alias("at"), F.flatten(r["outs"]).alias("out")))


def placed(gaps: Column, match: Column) -> Column:
    """array<struct(value, start, end)> of the matches and the gaps around them
    (array columns); without matches the gaps are not looked at."""
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(match)), match, lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("value"), F.char_length(m).alias("n")))

    def step(at, s):
        end = at + s["gap"] + s["n"]
        return end, F.array(F.struct(s["value"].alias("value"), (at + s["gap"]).alias("start"), end.alias("end")))

    kind = "struct<value:string,start:int,end:int>"
    return F.when(F.size(match) > 0, scan(steps, kind, step)["out"]).otherwise(F.array().cast(f"array<{kind}>"))


def checked(kind: str):
    return lambda m: valid(kind, m["value"])


def numbered(k: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def base_spans(text: Column, found: list[Column]) -> Column:
    """The base spans in order of start and kind; ``found``: each kind's matches."""
    each = [F.transform(F.filter(placed(F.split(text, PATTERNS[kind], -1), m), checked(kind)), numbered(k)) for k, (kind, m) in enumerate(zip(KINDS, found))]
    return F.array_sort(F.concat(*each))


def shown(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def seed_of(run: Column, base: list[Column], powers: list[Column]) -> Column:
    """The kind of the first base span that touches the run, else -1. A kind's
    spans don't overlap, so a binary search (by falling powers of two) finds the
    first one that ends behind the run's start."""
    def of_kind(k):
        own = base[k]
        ends_before = lambda at, p: F.get(own, at + p - 1)["end"] <= run["start"]
        first = F.aggregate(powers[k], F.lit(0), lambda at, p: F.when(F.coalesce(ends_before(at, p), F.lit(False)), at + p).otherwise(at))
        return bind(F.get(own, first), lambda b: F.when(b["start"] < run["end"], F.struct(b["start"].alias("start"), F.lit(k).alias("kind"))))

    touching = F.array(*(of_kind(k) for k in range(len(KINDS))))
    return F.coalesce(F.array_min(touching)["kind"], F.lit(-1))


def instances(text: Column, base: Column, found: Column) -> Column:
    """The identifier-like runs with their neighbouring words and seed kind.
    The words come from the gaps that ``split`` leaves; where a gap is blank, from the
    run beyond it (its part up to a digit)."""
    words = lambda gaps: F.transform(gaps, lambda g: bind(F.filter(F.split(g, r"\s++"), lambda w: w != ""), lambda w: F.struct(F.get(w, F.lit(0)).alias("first"), F.get(w, F.size(w) - 1).alias("last"))))
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    own = [of_kind(k) for k in range(len(KINDS))]
    powers = lambda n: F.transform(F.sequence(F.floor(F.log2(n + 1)).cast("int"), F.lit(0)), lambda e: F.pow(F.lit(2), e).cast("int"))
    held = lambda gaps: F.struct(placed(gaps, found).alias("runs"), words(gaps).alias("words"), *(
        c.alias(f"own{k}") for k, c in enumerate(own)), *(powers(F.size(c)).alias(f"powers{k}") for k, c in enumerate(own)))
    tail = lambda r: F.regexp_extract(r["value"], r"(?s)^(?:.*[\s0-9])?+([^\s0-9]*+)$", 1)
    head = lambda r: F.regexp_extract(r["value"], r"^([^\s0-9]*+)", 1)

    def of_text(h):
        base_of, powers_of = [h[f"own{k}"] for k in range(len(KINDS))], [h[f"powers{k}"] for k in range(len(KINDS))]
        left = lambda i: F.coalesce(F.get(h["words"], i)["last"], F.when(i > 0, tail(F.get(h["runs"], i - 1))), F.lit(""))
        right = lambda i: F.coalesce(F.get(h["words"], i + 1)["first"], head(F.get(h["runs"], i + 1)), F.lit(""))
        return F.transform(h["runs"], lambda r, i: F.struct(
            r["start"].alias("start"), r["end"].alias("end"),
            F.lower(F.regexp_replace(r["value"], r"[^\p{L}\p{N}@.]", "")).alias("value"),
            F.concat(F.lit("L:"), F.lower(left(i))).alias("left"), F.concat(F.lit("R:"), F.lower(right(i))).alias("right"),
            seed_of(r, base_of, powers_of).alias("seed")))

    whole = bind(bind(F.split(text, RUN, -1), held), of_text)
    return F.when(F.size(found) > 0, whole).otherwise(F.array())


def discovered(rows: DataFrame, rounds: int, min_support: int, min_confidence: float) -> DataFrame:
    """(id, key, found: the added spans) of the rows that gain some."""
    runs = rows.select("id", "key", F.explode("runs").alias("r")).select("id", "key", "r.*")
    edges = written(runs.select("value", "seed", F.explode(F.array("left", "right")).alias("pattern")).where(F.length("pattern") > 2)
                    .groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    seeds = written(edges.where("seed >= 0").select("value", "seed").distinct().select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")), "pii-seeds")
    score = seeds
    degree = written(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pii-degrees")
    for step in range(rounds):
        of_kind = edges.select("pattern", "value").join(score, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.count("*").alias("support")).where(F.col("support") >= min_support)
        accepted = of_kind.join(degree, "pattern").withColumn("confidence", F.col("total") / (F.col("n") + 1)).where(F.col("confidence") >= min_confidence).select("pattern", "kind", "confidence")
        accepted = written(accepted, f"pii-accepted-{step}")
        reached = edges.where("seed < 0").join(accepted, "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        score = written(seeds.unionByName(reached).groupBy("value", "kind").agg(F.max("score").alias("score")), f"pii-scores-{step}")
    best = score.where(F.col("score") >= min_confidence).groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k")))["k"].alias("k")).select("value", (-F.col("k")).alias("kind"))
    added = runs.where("seed < 0").join(written(best, "pii-best"), "value")
    return added.groupBy("id", "key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("found"))


def find(docs: DataFrame, rounds: int = 2, min_support: int = 5, min_confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, base, spans): the base spans and all spans of each row, as
    sorted arrays of struct(start, kind number, end); ``key`` tells texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    # each step is a column of its own, so that later ones read it instead of matching anew
    scanned = slim.select("*", *(matches(F.col("text"), p).alias(k) for k, p in (PATTERNS | {"run": RUN}).items()))
    scanned = scanned.withColumn("base", base_spans(F.col("text"), [F.col(k) for k in KINDS]))
    scanned = scanned.withColumn("runs", instances(F.col("text"), F.col("base"), F.col("run")))
    rows = written(scanned.select("id", "key", "base", "runs"), "pii-rows")
    extra = discovered(rows.where(F.size("runs") > 0), rounds, min_support, min_confidence)
    joined = rows.drop("runs").alias("r").join(extra.alias("x"), F.expr("r.id <=> x.id AND r.key = x.key"), "left").select("r.id", "r.key", "base", "found")
    return joined.withColumn("spans", F.when(F.col("found").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "found")))).drop("found")


def part(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, taken from the blocks that hold it."""
    first = F.floor(start / BLOCK).cast("int")
    own = F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1)
    return F.when(end > start, F.substr(F.array_join(own, ""), start - first * BLOCK + 1, end - start)).otherwise("")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones as one, named after the first) as ``[KIND]``."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def of_blocks(blocks):
        def step(at, s):
            new = F.array(part(blocks, at, s["start"]), F.element_at(names, s["kind"] + 1))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, new).otherwise(F.array().cast("array<string>"))

        return bind(scan(spans, "string", step), lambda r: F.concat(F.array_join(r["out"], ""), part(blocks, r["at"], F.char_length(text))))

    return bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), of_blocks)


def mask_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all spans masked in ``text`` (``n_chars`` follows)."""
    found = find(docs, **options).where(F.size("spans") > 0).groupBy("id", "key").agg(F.first("spans").alias("spans"))
    found = written(found.select(*(F.col(c).alias(f"__{c}") for c in found.columns)), "pii-spans")
    text = F.coalesce("text", F.lit(""))
    joined = docs.withColumn("__text", F.xxhash64(text)).join(small(found, row_bytes=128, more=SPAN_BYTES * F.size("__spans")), F.expr("doc_id <=> __id AND __text = __key"), "left")
    joined = joined.withColumn("__new", F.when(F.col("__spans").isNotNull(), masked(F.col("text"), F.col("__spans"))))
    new = {"text": F.coalesce("__new", "text"), "n_chars": F.coalesce(F.char_length("__new").cast("long"), "n_chars") if "n_chars" in docs.columns else None}
    return joined.select(*(new[c].alias(c) if new.get(c) is not None else F.col(f"`{c}`") for c in docs.columns))
