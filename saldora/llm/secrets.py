"""Secret scans with sliding-window Shannon entropy, in Spark SQL functions only.

Three fixed kinds come from patterns: assign, access and hex. The method adds kind entropy: candidate strings (runs of
characters of a class, at least WINDOW long, with a digit) whose Shannon entropy, in the best window of WINDOW
characters, reaches the threshold of their class (hex digits, letters and digits, base64). Besides the whole string,
its runs of PARTS of at least WINDOW characters are held against the thresholds of their own classes, so that a name
in front of a key does not raise what the key must reach; the span is the whole string. The window slides by one:
counts of its characters and the sum of c * log2(c) are carried on and changed by the character that leaves and the
one that enters. Candidates on the allow-list are not added. Spans of the fixed kinds are blanked first, one kind after
the other as listed, each in what the one before left, so that a secret that holds such a span is judged by the rest.

Spans are [start, end) in code points of the whole match. They are taken from the lengths of what split() leaves
between matches and of the matches themselves, which come from the same left-to-right search.

Defined cases. A null or empty text has no spans. Very long runs are scanned in one pass, in time proportional to
their length. Repeated rows are scanned each; an empty table gives none. Columns other than doc_id and text are not
looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the three kinds, and the least length of what they must have found.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

RUN = 256
WINDOW = 20
#: Counts of a window's characters are at most WINDOW + 1 and take so many bits; so many of them make a long.
BITS, FIELDS = 5, 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: Least entropy in bits a character of the best window, by class: the first class that holds all characters counts.
CLASSES = ((r"^[0-9A-Fa-f]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.6), (r"^.*$", 3.9))
#: Strings that look random but are known to be harmless; see also worded(). No group is repeated in any pattern of this
#: module: Java goes one call deeper for each repetition of a group, which ends in a stack overflow on long strings.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",  # UUID
    r"^[0-9=_+/-]+$",  # numbers, dates, rulers
    r"(?i)example|placeholder|changeme|your[_-]",  # documentation
)
#: Runs within a candidate that are judged by themselves: without = _ -, letters and digits, hex digits.
PARTS = tuple(rf"[{c}]{{{WINDOW},}}" for c in ("A-Za-z0-9+/", "A-Za-z0-9", "0-9A-Fa-f"))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(text: Column, pattern: str) -> Column:
    """array<struct<gap, m>>: every match with the text before it, and at last the text that is left, with a null m."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches.

    Places are summed up in runs of RUN matches, so that no array over all matches is copied at each of them."""
    step = F.filter(F.transform(pieces(text, pattern), lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["m"].alias("m"))), lambda x: x["m"].isNotNull())
    one_run = "array<struct<start: int, end: int, found: string>>"
    none = F.expr(f"cast(array() as {one_run})")
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{one_run}>)").alias("runs"))

    def add(acc, x):
        at = acc["at"] + x["gap"]
        end = at + F.length(x["m"])
        one = F.struct(at.alias("start"), end.alias("end"), x["m"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def add_run(acc, part):
        begin = F.struct(acc["at"].alias("at"), none.alias("out"))
        return F.aggregate(part, begin, add, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["runs"], F.array(r["out"])).alias("runs")))

    def summed(steps):
        parts = F.transform(F.sequence(F.lit(0), (F.size(steps) - 1).cast("int"), F.lit(RUN)), lambda k: F.slice(steps, k + 1, F.lit(RUN)))
        return F.when(F.size(steps) == 0, none).otherwise(F.aggregate(parts, start, add_run, lambda acc: F.flatten(acc["runs"])))

    return let(step, summed)


def blanked(text: Column, pattern: str, real=lambda m: F.lit(True)) -> Column:
    """text with the matches that are real replaced by as many spaces."""
    blank = lambda m: F.when(m.isNull(), "").when(real(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m)
    return F.array_join(F.transform(pieces(text, pattern), lambda x: F.concat(x["gap"], blank(x["m"]))), "")


def best_entropy(found: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any window characters in a row; found has at least that many.

    The counts of the window's characters are kept in fields of BITS bits, FIELDS to a long."""
    codes = F.transform(F.filter(F.split(found, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    table = F.array(*[F.expr(f"double({c} * coalesce(log2({c}), 0))") for c in range(window + 2)])
    weigh = lambda c: F.get(table, c)
    count = lambda n, c: F.call_function("shiftright", F.get(n, F.floor(c / FIELDS).cast("int")), (c % FIELDS) * BITS).bitwiseAND(F.lit(2**BITS - 1).cast("long")).cast("int")
    one = F.array(*[F.lit(1 << (BITS * k)) for k in range(FIELDS)])
    bump = lambda n, c, sign: F.transform(n, lambda x, i: F.when(i == F.floor(c / FIELDS), x + sign * F.get(one, c % FIELDS)).otherwise(x))
    zero = F.struct(F.array(*[F.lit(0).cast("long")] * -(-len(ALPHABET) // FIELDS)).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("low"))

    def slide(acc, x):
        c = count(acc["n"], x["enter"])
        n1, s1 = bump(acc["n"], x["enter"], 1), acc["s"] + weigh(c + 1) - weigh(c)
        return F.struct(n1.alias("n"), s1.alias("s"), acc["low"].alias("low"))

    def out(acc, x):
        d, full = count(acc["n"], x["leave"]), x["i"] >= window
        n2 = F.when(full, bump(acc["n"], x["leave"], -1)).otherwise(acc["n"])
        s2 = F.when(full, acc["s"] + weigh(d - 1) - weigh(d)).otherwise(acc["s"])
        return F.struct(n2.alias("n"), s2.alias("s"), F.when(x["i"] >= window - 1, F.least(acc["low"], s2)).otherwise(acc["low"]).alias("low"))

    def least(c):
        leave = lambda i: F.when(i >= window, F.get(c, i - window)).otherwise(0)
        steps = F.transform(c, lambda e, i: F.struct(e.alias("enter"), leave(i).alias("leave"), i.alias("i")))
        return F.aggregate(steps, zero, lambda acc, x: let(slide(acc, x), lambda a: out(a, x)), lambda acc: acc["low"])

    # H = log2(window) - sum(c * log2(c)) / window: the best window has the least sum.
    return F.log2(F.lit(float(window))) - let(codes, least) / window


def worded(found: Column) -> Column:
    """Whether found is a path made of words, or a slug or name with a number behind. A step of a path is a letter with
    or without a digit, or words (in capitals, in small letters, with or without a capital, or camel case), joined by
    single dashes, with up to four digits behind. Letters are first written as marks: ',' for a capital and small
    letters, then ';' for a whole word; what is left has a form that classes of characters can tell."""
    single = F.regexp_replace(found, r"(?<=^|/)[A-Za-z][0-9]?(?=/|$)", ";")
    camel = F.regexp_replace(single, "[A-Z][a-z]{2,}", ",")
    marks = F.regexp_replace(camel, "[A-Z]{2,},*|[a-z]{2,},*|,+", ";")
    is_path = lambda m: (
        m.rlike("^[;_/0-9-]+$") & m.rlike("^/?[^/]+/") & ~m.rlike(";;|[-_]{2}|//") & ~F.regexp_replace(m, "^/|/$", "").rlike("(?:^|/)[^;]")
        & ~m.rlike("[0-9][^0-9/]") & ~m.rlike("[0-9]{5}"))
    slug = found.rlike("^[A-Za-z][A-Za-z_-]*[0-9]{1,4}$") & ~found.rlike("[-_]{2}")
    return slug | (F.contains(found, F.lit("/")) & let(marks, is_path))


def harmless(found: Column) -> Column:
    return worded(found) | ~found.rlike("[0-9]") | ~found.rlike("[A-Za-z]") | reduce(lambda a, b: a | b, [found.rlike(p) for p in ALLOWED])


def reaches(found: Column) -> Column:
    """Whether the best window reaches the threshold of found's class."""
    least = reduce(lambda rest, c: F.when(found.rlike(c[0]), F.lit(c[1])).otherwise(rest), reversed(CLASSES), F.lit(None).cast("double"))
    return best_entropy(found) >= least


def high_entropy(found: Column) -> Column:
    parts = F.array_distinct(F.concat(*[F.regexp_extract_all(found, F.lit(p), F.lit(0)) for p in PARTS]))
    some = lambda: F.exists(parts, lambda x: (x != found) & F.when(harmless(x), False).otherwise(reaches(x)))
    return F.when(harmless(found), False).when(reaches(found), True).otherwise(some())


def written(spans_: Column) -> Column:
    """kind:start:end, by start, then kind as listed, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans_), lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, base and all (arrays of struct<start, kind, end>); spans are whole matches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start: int, end: int, found: string>>)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.when(F.col("t").rlike(ASSIGN), spans(F.col("t"), ASSIGN)).otherwise(none).alias("assign"),
        F.when(F.contains("t", F.lit("AKIA")), spans(F.col("t"), ACCESS)).otherwise(none).alias("access"),
        # The runs of 16 and more are just the matches of the kind that are long enough, for both patterns below.
        F.when(F.col("t").rlike(f"[0-9a-f]{{{HEX_LEAST},}}"), spans(F.col("t"), f"[0-9a-f]{{{HEX_LEAST},}}")).otherwise(none).alias("hex"),
        F.when(F.col("t").rlike(CANDIDATE), F.col("t")).alias("t"))
    assigned = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    long_enough = F.filter("assign", lambda x: assigned(x["found"]))
    access = F.filter("access", lambda x: x["end"] - x["start"] >= ACCESS_LEAST)
    rows = rows.select("doc_id", long_enough.alias("assign"), access.alias("access"), "hex", "t")
    free = F.when(F.size("assign") > 0, blanked(F.col("t"), ASSIGN, assigned)).otherwise(F.col("t"))
    free = F.when(F.size("access") > 0, blanked(free, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")).otherwise(free)
    free = F.when(F.size("hex") > 0, blanked(free, f"[0-9a-f]{{{HEX_LEAST},}}")).otherwise(free)
    more = F.filter(let(free, lambda t: spans(t, CANDIDATE)), lambda x: x["found"].rlike("[0-9]"))
    rows = rows.select("doc_id", "assign", "access", "hex", F.when(F.col("t").isNotNull(), more).otherwise(none).alias("more"))
    as_kind = lambda c, k: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    rows = rows.withColumn("base", F.concat(*[as_kind(c, k) for k, c in enumerate(KINDS[:3])]))
    added = F.filter("more", lambda x: high_entropy(x["found"]))
    return rows.select("doc_id", "assign", "access", "hex", "base", F.when(F.size("more") == 0, F.col("base")).otherwise(F.concat("base", as_kind(added, 3))).alias("all"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return scan(docs).select("doc_id", size("assign"), size("access"), size("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all")).alias("spans"))
